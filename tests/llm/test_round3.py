"""SimHash, collocations and hard negatives against plain Python, with nulls, empties, ties, repeats, clashing columns and hot groups."""

from __future__ import annotations

import base64
import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aircensus.llm import collocations, hard_negatives, secret_scan, simhash

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def low(text):
    return (text or "").translate(LOWER)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---- 11 ----------------------------------------------------------------------------------------


def brute_code(text):
    w = SPACE.findall(low(text))
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(codes, bits):
    """Smallest place of each code's component."""
    label, x = list(range(len(codes))), np.array(codes, np.uint64)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= bits).tolist():
            a, b = root(i), root(i + 1 + j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(x))]


def brute_simhash(rows, bits=4):
    codes = [brute_code(t) for _, t in rows]
    roots = classes(codes, bits)
    least = {}
    for (doc, _), r in zip(rows, roots):
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return sorted(((doc, f"{c:016x}", least.get(r)) for (doc, _), c, r in zip(rows, codes, roots)), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    prose = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    out = [prose(rng.randrange(1, 200)) for _ in range(60)]
    base = prose(400).split(" ")
    for k in range(12):
        copy = list(base)
        for _ in range(k // 3):
            copy[rng.randrange(len(copy))] = f"edit{k}"
        out.append("  ".join(copy).upper() if k % 4 == 0 else " ".join(copy))
    out += ["", " \t\n", None, "one", "One", "one two three", "ünï ñandú " * 40, prose(90_000), *[out[0]] * 40]
    rows = list(enumerate(out))
    return [*rows, (None, out[3]), (None, "alone of its kind here today"), (5, prose(50)), (5, out[5])]


def documents(spark, rows):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("code", "component", "fingerprint"))])
    return spark.createDataFrame([(i, t, "clash", None, "clash") for i, t in rows], schema)


def test_simhash(spark, texts):
    got = simhash.simhash_duplicates(documents(spark, texts))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == brute_simhash(texts)


def test_simhash_of_an_empty_table(spark):
    assert simhash.simhash_duplicates(documents(spark, [])).count() == 0


def test_simhash_hash_is_the_one_of_the_engine(spark):
    row = spark.sql("SELECT xxhash64('ab cd ef gh') AS h").first()
    assert row.h & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"ab cd ef gh", 42)


@pytest.mark.parametrize("block", [40, 1 << 15])
def test_every_close_pair_of_codes_is_linked(spark, block):
    """Clusters, chains of four bits, one code far from all; blocks of one size and many of another."""
    rng = random.Random(3)
    codes = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40):
        c = rng.choice(sorted(codes))
        for _ in range(rng.randrange(1, 12)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                c ^= 1 << b
            codes.add(c)
    hot = rng.getrandbits(64)
    codes |= {hot ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)}
    codes = sorted(codes)
    table = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "code long")
    found = simhash.links(table, 4, block).collect()
    assert len(found) < 12 * len(codes)  # a forest for each pair of blocks, not all pairs of the hot group
    place = {c: i for i, c in enumerate(codes)}
    label = list(range(len(codes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in found:
        a, b = (place[v & (1 << 64) - 1] for v in (r.a, r.b))
        assert bin(codes[a] ^ codes[b]).count("1") <= 4 or root(a) >= 0
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    assert [root(i) for i in range(len(codes))] == classes(codes, 4)


def test_gray_ranks_follow_the_gray_order(spark):
    got = spark.range(64).select(simhash.gray_rank(F.col("id")).alias("r")).collect()
    order = sorted(range(64), key=lambda i: got[i].r)
    assert order == [i ^ i >> 1 for i in range(64)]


# ---- 12 ----------------------------------------------------------------------------------------


def brute_collocations(rows, least, top):
    parts = re.compile(r"[.,;:!?\x0A-\x0D]")
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        for piece in parts.split(low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                counts[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        held = [g for g in f if len(g) >= 2 and f[g] >= least]
        swallowed = {g[i:j] for g in held for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g) and f[g] >= f[g[i:j]]}
        scored = []
        for g in held:
            cuts = [(1000 * f[g] * n[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            if g not in swallowed:
                scored.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out, key=str)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    out = []
    for i in range(300):
        w = []
        while len(w) < 60:
            w += rng.choice([["New", "York", "city"], ["the"], ["of", "the"], ["the", "the", "the"], ["ÉTÉ", "chaud"], [f"x{rng.randrange(500)}"], ["a", "b", "c", "d", "e", "f"], ["stop."], ["tab\tbed"], ["line\nend"]])
        out.append((rng.choice(["en", "fr", None]), " ".join(w)))
    out += [("en", None), (None, ""), ("xx", "never twice"), ("en", "the " * 5000), *[("de", "immer wieder gleich, ja")] * 30]
    return out


@pytest.mark.parametrize(("least", "budget", "top"), [(25, 1 << 19, 2000), (25, 40, 2000), (12, 400, 7)])
def test_collocations(spark, passages, least, budget, top):
    """Any budget gives the same phrases: small ones make prefixes of up to five words and many groups."""
    table = spark.createDataFrame([(lang, t, "clash", 1) for lang, t in passages], "lang string, text string, phrase string, n int")
    got = collocations.collocations(table.repartition(5), least=least, budget=budget, top=top)
    assert rows_of(got, *COLUMNS) == brute_collocations(passages, least, top)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_groups_keep_the_budget():
    totals = {i: (7 * i) % 50 + 1 for i in range(200)} | {500: 90}
    group = collocations.pack(totals, 100)
    held = collections.Counter()
    for slot, total in totals.items():
        held[int(group[slot])] += total
    assert max(held.values()) <= 100 and len(held) < 80


# ---- 13 ----------------------------------------------------------------------------------------


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (3, 70, 5), (64, 64, 64), (37, 129, 90), (100, 16, 33), (0, 5, 4)):
        x, y = rng.integers(-(2**20), 2**20, (m, k)), rng.integers(-(2**20), 2**20, (k, n))
        assert np.array_equal(hard_negatives.strassen(x, y, 4), x @ y)


def brute_negatives(rows, positives=5, negatives=3):
    part = [(i, v, [int(np.floor(256 * float(x))) for x in vec], label) for i, (v, vec, label) in enumerate(rows) if v is not None and label is not None and vec is not None and all(x is not None and np.isfinite(x) for x in vec)]
    part = [(i, v, vec, (label + 1) % 10 if v % 7 == 0 else label) for i, v, vec, label in part]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, v, vec, label in part:
        if v % 50:
            continue
        scored = [(-dot(vec, w), u, j, other) for j, u, w, other in part if j != i]
        best = sorted(x for x in scored if x[3] == label)[:positives]
        for s, u, _, _ in best:
            window = sorted((n, w) for n, w, _, other in scored if other != label and -50 * s <= -100 * n <= -95 * s)[:negatives]
            out += [(v, u, r, w, -s, -n) for r, (n, w) in enumerate(window, 1)]
    return sorted(out, key=str)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 12))
    rows = [(int(v), (centres[v % 4] + rng.normal(size=12) * 0.7).tolist(), int(rng.integers(0, 3)) if v % 5 else 1) for v in range(400)]
    rows += [(1000, rows[50][1], 2), (50, rows[50][1], 1), (50, rows[50][1], rows[50][2]), *[(2000 + i, rows[100][1], 1) for i in range(30)]]
    bad = [(None, [1.0] * 12, 1), (3000, None, 1), (3050, [1.0, None], 1), (3100, [float("nan")], 1), (3150, [float("inf"), 1.0], 1), (3200, [1.0] * 12, None)]
    short = [(3250, [], 1), (3300, [2.0, 1.0, 0.5], 1), (-50, [1.5] * 12, 2), (3350, [0.1] * 13, 7)]
    return rows + bad + short


@pytest.mark.parametrize(("anchors", "candidates"), [(512, 1024), (3, 16)])
def test_hard_negatives(spark, vectors, anchors, candidates):
    """Tiles of any size give the same rows; hot labels, repeated vectors, ties and unequal lengths."""
    table = spark.createDataFrame([(v, vec, label, "x", 1) for v, vec, label in vectors], "vec_id long, embedding array<double>, label int, tile string, row int").repartition(6)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.hard_negatives(table, label, F.col("vec_id") % 50 == 0, anchor_rows=anchors, candidate_rows=candidates)
    assert rows_of(got, *NEGATIVES) == brute_negatives(vectors)


def test_hard_negatives_of_empty_tables(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(table, F.col("label"), F.col("vec_id") % 50 == 0).count() == 0
    lone = spark.createDataFrame([(1, [0.5], 1), (2, [0.5], 2)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(lone, F.col("label"), F.col("vec_id") % 50 == 0).count() == 0


# ---- 5: forms of keys -----------------------------------------------------------------------------


def tlv(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else (n := (len(body).bit_length() + 7) // 8) and bytes([0x80 | n]) + len(body).to_bytes(n, "big")
    return bytes([tag]) + size + body


def rsa_key(octets=64):
    half = b"\x7f" + b"p" * (octets // 2)
    numbers = [b"\0", b"\x7e" + b"n" * octets, b"\1\0\1", b"\x7d" + b"d" * octets, half, half, half, half, half]
    return tlv(0x30, b"".join(tlv(2, x) for x in numbers))


def found_in(text):
    return [(secret_scan.KINDS[k], text[a:b]) for a, k, b in secret_scan.confirmed_spans(text)]


def test_a_digest_is_no_key():
    """The wrapping of a SHA-256 inside a signature, and nine integers of one byte."""
    digest = tlv(0x30, tlv(0x30, tlv(6, bytes.fromhex("608648016503040201")) + tlv(5, b"")) + tlv(4, b"h" * 32))
    assert found_in(digest.hex()) == [] and not secret_scan.is_der_key(digest)
    assert not secret_scan.is_der_key(tlv(0x30, tlv(2, b"\0") + tlv(2, b"\1") * 8))


def test_encrypted_keys_name_their_scheme():
    rounds = tlv(0x30, tlv(4, b"saltsalt") + tlv(2, b"\x08\0"))
    pbes2 = tlv(0x30, tlv(6, secret_scan.PBES2) + tlv(0x30, tlv(0x30, tlv(6, secret_scan.DERIVATIONS[0]) + rounds) + tlv(0x30, tlv(6, bytes.fromhex("60864801650304012a")) + tlv(4, b"v" * 16))))
    pbes1 = tlv(0x30, tlv(6, secret_scan.PBES1[0]) + rounds)
    for scheme in (pbes2, pbes1):
        assert secret_scan.is_der_key(tlv(0x30, scheme + tlv(4, b"c" * 64)))
    assert not secret_scan.is_der_key(tlv(0x30, tlv(0x30, tlv(6, secret_scan.PBES2) + tlv(5, b"")) + tlv(4, b"c" * 64)))


def test_armour_with_headers():
    body = base64.encodebytes(rsa_key()).decode()
    plain = f"-----BEGIN RSA PRIVATE KEY-----\nComment: old-key\n\n{body}-----END RSA PRIVATE KEY-----"
    secret = base64.encodebytes(bytes(range(256))).decode()
    locked = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{'0A' * 16}\n\n{secret}-----END RSA PRIVATE KEY-----"
    assert found_in(f"x {plain} y") == [("pem", plain)] and found_in(locked) == [("pem", locked)]
    assert found_in(locked.replace("AES-128-CBC,", "DES-EDE3-CBC,")) == [] and found_in(locked.replace(secret, secret[:-9] + "\n")) == []


def test_wrapped_and_prefixed_runs():
    code = base64.b64encode(rsa_key()).decode()
    lines = "\n".join(code[i : i + 64] for i in range(0, len(code), 64))
    assert found_in(f"key:\n{lines}\nthe end") == [("der", lines)]
    assert found_in(f"key:\r\n{lines.replace(chr(10), chr(13) + chr(10) + '  ')}") == [("der", lines.replace("\n", "\r\n  "))]
    for prefix in ("/home/x/", "https://host/a/b/", "ab/", "abc/"):
        assert found_in(f"at {prefix}{code} end") == [("der", code)]
    assert found_in("/" + "M" * 500 + " " + "MIIB" * 400) == []
    assert found_in("see " + base64.b64encode(code.encode()).decode()) == [("der", base64.b64encode(code.encode()).decode())]


def test_long_runs_are_read_once():
    text = ("MIIEpAIBAAKCAQEA" * 20_000 + "\n") * 2 + "-----BEGIN PRIVATE KEY-----\n" * 20_000
    assert found_in(text) == []

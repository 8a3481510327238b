"""PII scan with bootstrapped contextual extraction.

Base patterns find e-mail addresses, IPv4 addresses, card numbers (Luhn) and
phone numbers.  The method then bootstraps: base entities are the first believed
instances; the two words left of an instance are a lexical pattern; the graph of
patterns and instances is scored in rounds on Spark.  A pattern is confident if
it leads to ``MIN_SEEDS`` different believed instances and these make up a share
of ``MIN_CONFIDENCE`` of all its occurrences in the corpus; what stands in the
slot of a confident pattern is believed from then on, wherever it occurs, and so
can make further patterns confident.  Rounds end when no pattern is added.
Identifier-like tokens in the slots of confident patterns are reported as
``ident``.

One pass over the text leaves base spans, candidates and their patterns in the
shared folder; a second counts all occurrences of the patterns that have enough
different instances.  The rounds work on distinct (pattern, instance) pairs with
partial aggregation, so a pattern or identifier in a third of all rows is
combined before it is shuffled.

Nulls and empty texts have no spans; each input row gives one output row,
repeated rows and null ids included; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from . import textkit as tk

KINDS = ("email", "ip", "card", "phone", "ident")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_EMAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits can't match where the run's first digit didn't; so long runs are read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/@+-]*[A-Za-z0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Least different believed instances of a confident pattern, and their least share of its occurrences.
MIN_SEEDS, MIN_CONFIDENCE = 5, 0.5
#: Shortest identifier-like token, and its least number of digits.
MIN_LENGTH, MIN_DIGITS = 6, 3

_SPANS = "array<struct<start:int,kind:int,end:int>>"
_SCHEMA = f"rid long, key long, doc_id long, base {_SPANS}, cands array<struct<start:int,end:int,seed:int,pattern:long,instance:long>>"
_ARROW = pa.schema([
    ("rid", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
    ("cands", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("pattern", pa.int64()), ("instance", pa.int64())]))),
])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, leftmost and non-overlapping per kind."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _EMAIL_LEFT:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def candidates(text: str, base: list[tuple[int, int, int]]):
    """(start, end, seed, left words) of identifier-like tokens that follow two words."""
    out = []
    seeds = [(a, b) for a, _, b in base]
    slots = [(a, b, 1) for a, b in seeds]
    if _DIGIT.search(text):
        k = 0
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            if b - a < MIN_LENGTH or len(_DIGIT.findall(m[0])) < MIN_DIGITS:
                continue
            while k < len(seeds) and seeds[k][1] <= a:
                k += 1
            if not any(s < b and a < e for s, e in seeds[k : k + 4]):
                slots.append((a, b, 0))
    words = [m.span() for m in tk.SPACE_WORDS.finditer(text)] if slots else []
    at = 0
    for a, b, seed in sorted(slots):
        while words[at][1] <= a:  # the word that holds the instance
            at += 1
        if at >= 2:
            (p, q), (r, t) = words[at - 2 : at]
            out.append((a, b, seed, f"{text[p:q]} {text[r:t]}"))
    return out


def pattern_hashes(column: pa.Array):
    """Hash of each two adjacent words of each text: (hashes, are both of one text)."""
    for _, data, bounds in tk.chunks(column):
        low = tk.LOWER_LUT[data]
        starts, ends, firsts = tk.words(low, bounds, ~tk.SPACE_LUT[low])
        pairs = tk.gram_hashes(tk.word_hashes(low, starts, ends), 2)
        inside = np.ones(len(pairs), dtype=bool)
        inside[(firsts[1:-1] - 1)[(firsts[1:-1] > 0) & (firsts[1:-1] <= len(pairs))]] = False
        yield pairs, inside, firsts


def _scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rid = TaskContext.get().partitionId() << 33
    for batch in it:
        base, slots, owner = [], [], []
        for i, text in enumerate(batch["text"]):
            value = text.as_py() or ""
            spans = base_spans(value)
            base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
            slots += [(a, b, seed, left, _hash(value[a:b])) for a, b, seed, left in candidates(value, spans)]
            owner += [i] * (len(slots) - len(owner))
        cands: list[list[dict]] = [[] for _ in base]
        if slots:
            # Each context is one text of exactly two words, so every other pair is a pattern.
            hashes = np.concatenate([p[::2] for p, _, _ in pattern_hashes(pa.array([x[3] for x in slots], pa.string()))])
            for i, (a, b, seed, _, instance), h in zip(owner, slots, common.signed(hashes).tolist()):
                cands[i].append({"start": a, "end": b, "seed": seed, "pattern": h, "instance": instance})
        ids = pa.array(np.arange(rid, rid + batch.num_rows), pa.int64())
        rid += batch.num_rows
        yield pa.RecordBatch.from_arrays([ids, batch["key"], batch["doc_id"], pa.array(base, _ARROW.field("base").type), pa.array(cands, _ARROW.field("cands").type)], schema=_ARROW)


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, total: how often each pattern is followed by a word, in all documents.

    The patterns reach the tasks as a bitmap of fixed size; its false hits go in the join.
    """
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(patterns, "pattern"))
    schema = pa.schema([("pattern", pa.int64()), ("n", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for pairs, inside, firsts in pattern_hashes(batch["text"]):
                followed = inside.copy()
                last = firsts[1:] - 2  # a text's last pair leads to nothing
                followed[last[(last >= 0) & (last < len(pairs))]] = False
                hashes, n = np.unique(pairs[followed & common.in_bitmap(bits.value, pairs)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(hashes)), pa.array(n)], schema=schema)

    counts = docs.select("text").mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return counts.join(patterns.select("pattern"), "pattern", "left_semi")


def score_patterns(docs: DataFrame, cands: DataFrame) -> DataFrame:
    """Confident patterns of (seed, pattern, instance) rows: the fixed point of the rounds.

    Belief only grows, so the rounds end; a token that is believed anywhere is
    believed everywhere.
    """
    pairs = common.materialize(cands.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-pairs")
    fit = pairs.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("led")).filter(F.col("instances") >= MIN_SEEDS)
    fit = common.materialize(fit, "pii-fit")
    # Patterns that lead to other words too often can never become confident.
    hopeful = occurrences(docs, fit).join(fit.select("pattern", "led"), "pattern").filter(F.col("led") >= MIN_CONFIDENCE * F.col("total"))
    edges = common.materialize(pairs.select("pattern", "instance", "n").join(hopeful.select("pattern", "total"), "pattern"), "pii-edges")
    believed = common.materialize(pairs.filter("seed = 1").select("instance").distinct(), "pii-believed")
    count = 0
    while True:
        lead = edges.join(believed, "instance", "left_semi").groupBy("pattern").agg(F.count("*").alias("k"), F.sum("n").alias("led"), F.max("total").alias("total"))
        confident = common.materialize(lead.filter((F.col("k") >= MIN_SEEDS) & (F.col("led") >= MIN_CONFIDENCE * F.col("total"))).select("pattern"), "pii-confident")
        before, count = count, confident.count()
        if count == before:
            return confident
        found = edges.join(confident, "pattern", "left_semi").select("instance")
        believed = common.materialize(believed.unionByName(found).distinct(), "pii-believed")


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """rid, key, doc_id, base spans and discovered spans (arrays of start, kind, end) per document."""
    source = common.texts(docs, id_col, text_col) if key is None else docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    source = source if key is not None else source.withColumn("key", F.lit(None).cast("long"))
    first = common.materialize(source.mapInArrow(_scan, _SCHEMA), "pii-scan")
    cands = first.select("rid", F.explode("cands").alias("c")).select("rid", "c.*")
    good = score_patterns(source, cands)
    found = (
        cands.filter("seed = 0").join(good, "pattern", "left_semi").groupBy("rid")
        .agg(F.collect_set(F.struct("start", F.lit(KINDS.index("ident")).alias("kind"), "end")).alias("more"))
    )
    return first.select("rid", "key", "doc_id", "base").join(found, "rid", "left").withColumn("more", F.coalesce("more", F.from_json(F.lit("[]"), _SPANS)))


def _render(spans):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scanned.select(
        "doc_id", *(count(k) for k in range(4)), F.size("more").cast("long").alias("n_ident"),
        common.sha256(_render(F.col("base"))).alias("base_sha256"), _render(F.concat("base", "more")).alias("spans"),
    )


def op10_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_pii(common.table(spark, sf_dir, "documents")))


@F.pandas_udf(T.StringType())
def _masked(text: pd.Series, more: pd.Series) -> pd.Series:
    out = []
    for value, extra in zip(text, more):
        if value is None:
            out.append(None)
            continue
        spans = base_spans(value)
        if extra:
            spans = sorted(spans + [(int(a), KINDS.index("ident"), int(b)) for a, b in (x.split(":") for x in extra.split(","))])
        parts, at = [], 0
        for a, k, b in spans:
            if a >= at:
                parts += [value[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        out.append("".join(parts) + value[at:])
    return pd.Series(out, dtype=object)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with each span replaced by its kind in brackets; nothing else changes.

    Of overlapping spans the first names the mask and all go.  Discovered spans
    are matched to rows by id and text, so rows that repeat an id keep their own;
    null texts stay null.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = scan_pii(docs, id_col, text_col, key)
    pair = lambda s: F.concat_ws(":", s["start"], s["end"])
    more = common.materialize(
        found.filter(F.size("more") > 0).groupBy("key").agg(F.first("more").alias("more"))
        .select(F.col("key").alias("_pii_key"), F.array_join(F.transform(F.array_sort("more"), pair), ",").alias("_pii_more")),
        "pii-found",
    )
    none = lambda df: df.drop("_pii_key").withColumn("_pii_more", F.lit(None).cast("string"))
    if more.isEmpty():
        out = none(docs)
    else:
        clear, doubtful = common.split(docs.withColumn("_pii_key", key), more, "_pii_key")
        out = doubtful.join(more, "_pii_key", "left").drop("_pii_key")
        out = out if clear is None else none(clear).unionByName(out)
    out = out.select(*docs.columns, "_pii_more")
    return out.withColumn(text_col, _masked(F.col(text_col).cast("string"), "_pii_more")).drop("_pii_more")

"""Suffix-array dedup with difference-cover blockwise construction.

A byte goes if a ``WINDOW``-byte string that covers it also starts anywhere else
(in the same document or another), judged on the input; matches never cross
documents.

1. Windows are split into buckets by minimiser (see ``spans``); buckets with one
   occurrence hold nothing repeated and are dropped after a combined count.
2. A run of windows whose whole content occurs twice is repeated as it stands;
   equal runs collapse into one class with one representative.
3. Buckets that still hold several classes go through the suffix sorter: their
   representatives' bytes are dealt to tasks by bucket, and a task lays out one
   block of buckets at a time (about ``BLOCK`` bytes).  In the block the suffixes
   at the positions of a difference cover are ranked first, by their leading
   ``COVER`` bytes and then by doubling; each suffix bucket is sorted by the few
   bytes before the next cover position and, for all longer ties, by the rank
   there.  Neighbours in that order that agree on ``WINDOW`` bytes, compared
   byte for byte, are repeated.
4. A bucket with more than ``MAX_CLASSES`` classes never meets in one task: the
   128-bit digests of its windows are counted, combined before the shuffle.

Nulls and empty texts have no bytes.  Each row is a text of its own, so rows
that repeat (even with one id, or a null one) repeat each other's strings.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, spans
from . import textkit as tk

WINDOW, MINIMISER = 200, 24
#: Period of the difference cover, a square; bytes of a block; most classes of a sorted bucket.
COVER, BLOCK, MAX_CLASSES = 64, 1 << 20, 8192

_CONTEXT = "m long, rk long, lo long, off int, crowded boolean, body binary"
_CONTEXT_ARROW = pa.schema([("m", pa.int64()), ("rk", pa.int64()), ("lo", pa.int64()), ("off", pa.int32()), ("crowded", pa.bool_()), ("body", pa.binary())])
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _runs(texts: pa.Array, length: int):
    for row, data, bounds in tk.chunks(texts):
        n = len(data) - MINIMISER + 1
        if n > 0:
            at = np.arange(n)
            grams = tk.span_hash(tk.prefix_hash(data), at, at + MINIMISER)
            yield row, data.tobytes(), bounds, grams, spans.minimiser_runs(grams, bounds, length, MINIMISER)


def _keys(batch: pa.RecordBatch) -> np.ndarray:
    return batch["rk"].to_numpy(zero_copy_only=False)


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = _keys(batch)
            for row, raw, bounds, grams, (doc, lo, n, at) in _runs(batch["text"], length):
                if len(doc):
                    f = spans.digests(raw, lo, lo + n + length - 1)
                    columns = (common.signed(grams[at]), f[:, 0], np.zeros(len(doc), np.int64), keys[row + doc], lo - bounds[doc], n)
                    yield from pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=spans.RUNS_ARROW).to_batches(50_000)

    return docs.mapInArrow(emit, spans.RUNS)


def find_contexts(docs: DataFrame, wanted: DataFrame, buckets: DataFrame, length: int) -> DataFrame:
    """Bytes of the runs named by ``wanted`` (rk, lo); a few more may come along."""
    bits, crowded = spans.wanted_runs(wanted, buckets, MAX_CLASSES)

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = _keys(batch)
            for row, raw, bounds, grams, (doc, lo, n, at) in _runs(batch["text"], length):
                hit = common.in_bitmap(bits.value, spans.occurrence_key(keys[row + doc], lo - bounds[doc]))
                doc, lo, n, at = doc[hit], lo[hit], n[hit], at[hit]
                if len(doc):
                    body = [raw[a:b] for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist())]
                    columns = (common.signed(grams[at]), keys[row + doc], lo - bounds[doc], at - lo, common.in_bitmap(crowded.value, grams[at]), body)
                    yield from pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CONTEXT_ARROW)], schema=_CONTEXT_ARROW).to_batches(10_000)

    return docs.mapInArrow(emit, _CONTEXT)


def difference_cover(period: int) -> np.ndarray:
    """Residues whose differences give every residue modulo a square period: 0..s-1 and the multiples of s."""
    s = int(period**0.5)
    return np.unique(np.concatenate([np.arange(s), np.arange(0, period, s)]))


def _word_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as one big-endian number, which orders like the bytes."""
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | data[at + i].astype(np.uint64)
    return out


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    """Dense rank of each row of keys, the first key leading."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=np.int64)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def cover_ranks(data: np.ndarray, depth: int, period: int = COVER) -> np.ndarray:
    """Rank of the suffix at each cover position by its first ``depth`` bytes at least; -1 elsewhere.

    ``data`` must end with enough padding for reads past the last suffix.
    """
    n = len(data) - period - 8
    at = np.flatnonzero(np.isin(np.arange(n) % period, difference_cover(period)))
    rank = np.full(n + depth + 3 * period, -1, dtype=np.int64)
    rank[at] = _ranks([_word_at(data, at + i) for i in range(0, period, 8)])
    reach = period
    while reach < depth:
        rank[at] = _ranks([rank[at], rank[at + reach]])  # at + reach has the same residue
        reach *= 2
    return rank


def sort_block(bodies: list[bytes], offs: np.ndarray, buckets: np.ndarray, length: int = WINDOW, period: int = COVER) -> list[np.ndarray]:
    """For each body, which of its windows equal another window of the block.

    Windows are compared in suffix buckets: one minimiser (``buckets``) at one
    offset.  Bodies are laid out with their minimisers at multiples of the
    period, so a suffix bucket has one residue.
    """
    sizes = np.fromiter((len(b) for b in bodies), np.int64, len(bodies))
    lead = (-offs) % period
    slots = (lead + sizes + period - 1) // period * period
    base = np.cumsum(slots) - slots + lead
    total = int(slots.sum())
    data = np.zeros(total + 2 * length + 2 * period + 8, dtype=np.uint8)
    for b, body in zip(base.tolist(), bodies):
        data[b : b + len(body)] = np.frombuffer(body, dtype=np.uint8)
    rank = cover_ranks(data[: total + period + 8], length, period) if total else np.empty(0, np.int64)
    n = sizes - length + 1
    own = np.repeat(np.arange(len(bodies)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = base[own] + inner
    cover = difference_cover(period)
    step = np.array([min((c - r) % period for c in cover.tolist()) for r in range(period)])[at % period]
    head = _word_at(data, at) >> ((np.uint64(8) - step.astype(np.uint64)) * np.uint64(8) % np.uint64(64))
    head[step == 0] = 0
    order = np.lexsort([rank[at + step], head, offs[own] - inner, buckets[own]])
    a, b = order[:-1], order[1:]
    same = (buckets[own[a]] == buckets[own[b]]) & (offs[own[a]] - inner[a] == offs[own[b]] - inner[b])
    same = np.flatnonzero(same)
    for i in range(0, length, 8):  # byte for byte, over the pairs that still agree
        i = min(i, length - 8)
        same = same[_word_at(data, at[a[same]] + i) == _word_at(data, at[b[same]] + i)]
    hit = np.zeros(len(at), dtype=bool)
    hit[a[same]] = True
    hit[b[same]] = True
    return np.split(hit, np.cumsum(n)[:-1]) if len(n) else []


def _sorter(length: int):
    def finish(block: list[tuple]) -> pa.RecordBatch:
        m, rk, lo, off, bodies = zip(*block)
        rows: list[tuple] = []
        for key, first, hit in zip(rk, lo, sort_block(list(bodies), np.array(off), np.array(m), length)):
            rows += [(key, first + a, first + b + length - 1) for a, b in spans.true_runs(hit)]
        return spans.found_batch(rows)

    return spans.in_blocks(finish, 4, BLOCK)


def _window_digests(length: int):
    schema = pa.schema([(c, pa.int64()) for c in ("w1", "w2", "rk", "at")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                out = []
                for rk, lo, body in zip(part["rk"].to_pylist(), part["lo"].to_pylist(), part["body"].to_pylist()):
                    at = np.arange(len(body) - length + 1)
                    f = spans.digests(body, at, at + length)
                    out.append(np.column_stack([f, np.full(len(at), rk), lo + at]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """rk, start, end: byte spans of each row whose windows start elsewhere too."""
    kept = spans.repeated(common.materialize(find_runs(docs, length), "bytes-runs"), by_document=False)
    classes = common.materialize(kept.groupBy("m", "f").agg(F.count("*").alias("copies"), F.min(F.struct("rk", "lo")).alias("one")), "bytes-classes")
    common.release(docs.sparkSession)
    copied = classes.filter("copies > 1").select("m", "f")
    whole = kept.drop("doc_id").join(copied, ["m", "f"], "left_semi").select("rk", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + length - 1).alias("end"))
    whole = common.materialize(whole, "bytes-whole")
    common.discard(kept)
    common.release(docs.sparkSession)
    mixed = common.materialize(classes.groupBy("m").agg(F.count("*").alias("k")).filter("k > 1"), "bytes-mixed")
    chosen = classes.join(mixed, "m", "left_semi").select("one.rk", "one.lo")
    contexts = common.materialize(find_contexts(docs, chosen, mixed, length), "bytes-contexts")
    common.release(docs.sparkSession)
    blocks = (
        contexts.filter("not crowded").select("m", "rk", "lo", "off", "body").repartition("m").sortWithinPartitions("m")
        .mapInArrow(_sorter(length), "rk long, start long, end long")
    )
    spread_out = contexts.filter("crowded").mapInArrow(_window_digests(length), "w1 long, w2 long, rk long, at long")
    twice = spread_out.groupBy("w1", "w2").agg(F.count("*").alias("c")).filter("c > 1")
    single = spread_out.join(twice, ["w1", "w2"]).select("rk", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return whole.unionByName(blocks).unionByName(single)


def _finish(ids: pa.Array, texts: pa.Array, removed: list[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    for row, data, bounds in tk.chunks(texts):
        raw, out = data.tobytes(), []
        for d in range(len(bounds) - 1):
            lo, hi = int(bounds[d]), int(bounds[d + 1])
            at, digest = lo, hashlib.sha256()
            for a, b in removed[row + d]:
                digest.update(raw[at : lo + a])
                at = lo + b
            digest.update(raw[at:hi])
            out.append((hi - lo, sum(b - a for a, b in removed[row + d]), len(removed[row + d]), digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([ids.slice(row, len(out)), *(pa.array(c, t.type) for c, t in zip(zip(*out), list(_OUT_ARROW)[1:]))], schema=_OUT_ARROW)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    rows = spans.keyed(common.texts(docs, id_col, text_col))
    return spans.with_intervals(rows, repeated_spans(rows, length), _finish, _OUT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, i, md5(b[i : i + 199]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
twice AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win SEMI JOIN twice USING (h)),
part AS (SELECT doc_id, i, sum((before IS NULL OR i > before + 200)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
gone AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS z FROM part GROUP BY doc_id, g),
cuts AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list(z ORDER BY a) AS ends FROM gone GROUP BY doc_id)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       CASE WHEN starts IS NULL THEN sha256(b)
            ELSE sha256(unhex(list_reduce([hex(b[x[1] : x[2]]) FOR x IN list_zip(list_prepend(1, ends), list_append([s - 1 FOR s IN starts], octet_length(b)))], lambda p, q: p || q))) END AS kept_sha256
FROM d LEFT JOIN cuts USING (doc_id)
"""

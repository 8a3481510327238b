"""Minimiser buckets: how fixed-length windows are split among tasks.

Each window (``length`` consecutive symbols of one document) belongs to the
bucket of its minimiser, the k-gram in it with the least hash (the leftmost of
equals).  Equal windows have equal minimisers at equal offsets, so a window can
only equal windows of its own bucket, at its own offset.  Neighbouring windows
mostly share a minimiser: a maximal run of them is one row, which is what makes
buckets cheap to shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkit as tk

_POS_BITS = 24
_POS = np.uint64((1 << _POS_BITS) - 1)


def minimiser_runs(order: np.ndarray, bounds: np.ndarray, length: int, k: int):
    """Runs of windows with one minimiser.

    ``order`` has a hash for each k-gram of the chunk (also those that cross
    documents, which no window uses), ``bounds`` each document's first symbol.
    Returns (document, first window, windows, minimiser position), all absolute
    in the chunk.
    """
    empty = (np.empty(0, np.int64),) * 4
    windows_in = np.maximum(np.diff(bounds) - length + 1, 0)
    if len(order) < length - k + 1 or not windows_in.sum():
        return empty
    n = len(order)
    at = np.arange(n, dtype=np.uint64)
    if n <= 1 << _POS_BITS:
        least = tk.sliding_min((order & ~_POS) | at, length - k + 1) & _POS
    else:  # a document of over 16 M symbols: overlapping blocks, positions from each block's start
        step, w = (1 << _POS_BITS) - length, length - k + 1
        parts = []
        for lo in range(0, n - w + 1, step):
            block = order[lo : lo + step + w - 1]
            parts.append((tk.sliding_min((block & ~_POS) | at[: len(block)], w) & _POS) + np.uint64(lo))
        least = np.concatenate(parts)
    docs = np.repeat(np.arange(len(windows_in)), windows_in)
    starts = np.arange(len(docs)) - np.repeat(np.cumsum(windows_in) - windows_in, windows_in) + bounds[:-1][docs]
    mins = least[starts].astype(np.int64)
    new = np.empty(len(docs), dtype=bool)
    new[0] = True
    new[1:] = (mins[1:] != mins[:-1]) | (docs[1:] != docs[:-1])
    first = np.flatnonzero(new)
    return docs[first], starts[first], np.diff(np.append(first, len(docs))), mins[first]


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals as maximal disjoint runs (touching ones joined), in order."""
    out: list[list[int]] = []
    for i in np.lexsort((ends, starts)).tolist():
        a, b = int(starts[i]), int(ends[i])
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit content digests of raw[start:end], as rows of two int64."""
    fp = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([fp(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), dtype=np.int64).reshape(-1, 2)


def occurrence_key(rk: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Hash of (row key, first window), to name an occurrence of a run in a bitmap."""
    return tk.mix(rk.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64) + np.uint64(1))


def named(wanted: DataFrame) -> DataFrame:
    """h: occurrence_key of (rk, lo)."""

    def name(it):
        for batch in it:
            h = occurrence_key(batch["rk"].to_numpy(zero_copy_only=False), batch["lo"].to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(common.signed(h))], ["h"])

    return wanted.select("rk", "lo").mapInArrow(name, "h long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, rk: rows are told apart by id and text, so rows that repeat an id keep their own spans."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rk"))


#: A run: bucket, 64 bits of its content's digest (with the bucket's own hash, 128 bits), document, row, first window, windows.
RUNS = "m long, f long, doc_id long, rk long, lo long, n long"
RUNS_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in RUNS.split(", ")])


def repeated(runs: DataFrame, by_document: bool) -> DataFrame:
    """The runs of buckets with two occurrences (or, by_document, two documents) at least.

    Counting combines in the map tasks; what survives is told to the tasks that
    filter by a bitmap of fixed size, whose false hits later steps tolerate.
    ``runs`` must be materialised; it is deleted.
    """
    several = F.min("doc_id") < F.max("doc_id") if by_document else F.count("*") > 1
    buckets = runs.groupBy("m").agg(several.alias("several")).filter("several")
    bits = runs.sparkSession.sparkContext.broadcast(common.bitmap(buckets, "m"))

    def keep(it):
        for batch in it:
            m = batch["m"].to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(common.in_bitmap(bits.value, m)))

    kept = common.materialize(runs.mapInArrow(keep, RUNS), "span-kept")
    common.discard(runs)
    common.release(runs.sparkSession)
    return kept


def wanted_runs(wanted: DataFrame, buckets: DataFrame, most: int):
    """Broadcast bitmaps of the occurrences (rk, lo) to read again and of the buckets (m, k) with over ``most`` classes."""
    context = wanted.sparkSession.sparkContext
    return context.broadcast(common.bitmap(named(wanted), "h")), context.broadcast(common.bitmap(buckets.filter(F.col("k") > most), "m"))


def in_blocks(finish, weight: int, limit: int):
    """mapInArrow function over rows sorted by their first column: finish(rows) for each block of whole buckets.

    A block closes at the first new bucket after ``limit`` bytes of column ``weight``.
    """

    def run(it):
        block, size = [], 0
        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= limit and row[0] != block[-1][0]:
                    yield finish(block)
                    block, size = [], 0
                block.append(row)
                size += len(row[weight])
        if block:
            yield finish(block)

    return run


FOUND_ARROW = pa.schema([("rk", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 3)], schema=FOUND_ARROW)


def true_runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each maximal run of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def with_intervals(docs: DataFrame, intervals: DataFrame, finish, schema: str) -> DataFrame:
    """finish(text column, list of (starts, ends)) -> columns, for each document with its intervals (rk, start, end).

    Only documents that may have intervals are shuffled to meet them.
    """
    intervals = common.materialize(intervals, "span-intervals")
    common.release(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(intervals.select(F.xxhash64("rk").alias("h")), "h"))

    def touched(wanted: bool):
        def keep(it):
            for batch in it:
                hit = common.in_bitmap(bits.value, batch["h"].to_numpy(zero_copy_only=False).view(np.uint64))
                yield batch.filter(pa.array(hit == wanted)).select(["doc_id", "text", "rk"])

        return docs.select("*", F.xxhash64("rk").alias("h")).mapInArrow(keep, "doc_id long, text string, rk long")

    def apply(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                starts = part["starts"].to_pylist() if "starts" in part.schema.names else [None] * part.num_rows
                ends = part["ends"].to_pylist() if "ends" in part.schema.names else [None] * part.num_rows
                yield from finish(part["doc_id"], part["text"], [merge(np.array(a), np.array(b)) if a else [] for a, b in zip(starts, ends)])

    spans = intervals.groupBy("rk").agg(F.collect_set(F.struct("start", "end")).alias("s")).select("rk", F.col("s.start").alias("starts"), F.col("s.end").alias("ends"))
    return touched(False).mapInArrow(apply, schema).unionByName(touched(True).join(spans, "rk", "left").mapInArrow(apply, schema))

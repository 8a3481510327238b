"""Substring dedup by compacting a de Bruijn graph of tokens.

Edges of the graph are windows of ``WINDOW`` consecutive words, its nodes the
word sequences one shorter.  Edges are bucketed by minimiser, so neighbouring
edges of one document form a nonbranching path inside a bucket: one row.  Spark
joins compact the repeated paths: equal paths of many documents collapse into
one class with its smallest document, and a copy in a larger document goes
whole.  Where a bucket holds several classes the graph branches; the paths of
the classes' first documents are then cut into single edges, told apart by
128-bit digests, and an edge's smallest document decides.  Tasks get blocks of
whole buckets; the edges of a bucket with over ``MAX_CLASSES`` classes never meet
in one task, their smallest document is found by a combined aggregation.  Source coordinates (row, word position) carry every
verdict back, and the texts are only read again to apply it.

A word goes if a window that covers it also starts in a document with a smaller
doc_id, judged on the input.  Nulls and empty texts have no words.  Rows with a
null doc_id have no order: they lose nothing and cost nobody anything.  Rows
that repeat a doc_id do not remove each other's words; each keeps its own spans.
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

WINDOW, MINIMISER = 50, 8
#: Bytes of digests in a block; most classes of a bucket that one task handles.
BLOCK, MAX_CLASSES = 1 << 20, 8192

_PATHS = "m long, doc_id long, rk long, lo long, crowded boolean, edges binary"
_PATHS_ARROW = pa.schema([*((c, pa.int64()) for c in ("m", "doc_id", "rk", "lo")), ("crowded", pa.bool_()), ("edges", pa.binary())])
_EDGES = "w1 long, w2 long, doc_id long, rk long, at long"
_EDGES_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _EDGES.split(", ")])
_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _paths(batch: pa.RecordBatch, length: int):
    """Per chunk: first row, single-spaced bytes, word starts, ends, first words, and its minimiser runs."""
    for row, data, bounds in tk.chunks(batch["text"]):
        data, bounds = tk.single_spaced(data, bounds)
        starts, ends, firsts = tk.words(data, bounds, data != 0x20)
        grams = tk.gram_hashes(tk.word_hashes(data, starts, ends), MINIMISER)
        yield row, data.tobytes(), starts, ends, firsts, grams, spans.minimiser_runs(grams, firsts, length, MINIMISER)


def _ids(batch: pa.RecordBatch):
    return batch["doc_id"].to_numpy(zero_copy_only=False), batch["rk"].to_numpy(zero_copy_only=False)


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, keys = _ids(batch)
            for row, raw, starts, ends, firsts, grams, (doc, lo, n, at) in _paths(batch, length):
                if len(doc):
                    f = spans.digests(raw, starts[lo], ends[lo + n + length - 2])
                    own = row + doc
                    columns = (common.signed(grams[at]), f[:, 0], ids[own], keys[own], lo - firsts[doc], n)
                    yield from pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=spans.RUNS_ARROW).to_batches(50_000)

    return docs.filter("doc_id is not null").mapInArrow(emit, spans.RUNS)


def find_paths(docs: DataFrame, wanted: DataFrame, buckets: DataFrame, length: int) -> DataFrame:
    """The runs named by ``wanted`` (rk, lo) with the digests of their edges; a few more may come along."""
    bits, crowded = spans.wanted_runs(wanted, buckets, MAX_CLASSES)

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, keys = _ids(batch)
            for row, raw, starts, ends, firsts, grams, (doc, lo, n, at) in _paths(batch, length):
                hit = common.in_bitmap(bits.value, spans.occurrence_key(keys[row + doc], lo - firsts[doc]))
                doc, lo, n, m = doc[hit], lo[hit], n[hit], grams[at[hit]]
                if len(doc):
                    each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                    f = spans.digests(raw, starts[each], ends[each + length - 1])
                    edges = [part.tobytes() for part in np.split(f, np.cumsum(n)[:-1])]
                    columns = (common.signed(m), ids[row + doc], keys[row + doc], lo - firsts[doc], common.in_bitmap(crowded.value, m), edges)
                    yield from pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PATHS_ARROW)], schema=_PATHS_ARROW).to_batches(5000)

    return docs.filter("doc_id is not null").mapInArrow(emit, _PATHS)


def _later_edges(block: list[tuple]) -> list[np.ndarray]:
    """For each path of a block, which of its edges a smaller document of the bucket holds too."""
    m, doc, _, _, edges = zip(*block)
    f = [np.frombuffer(e, dtype=np.int64).reshape(-1, 2) for e in edges]
    n = np.array([len(x) for x in f])
    w = np.concatenate(f)
    buckets, docs = np.repeat(np.array(m), n), np.repeat(np.array(doc), n)
    order = np.lexsort((docs, w[:, 1], w[:, 0], buckets))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (w[order][1:] != w[order][:-1]).any(axis=1) | (buckets[order][1:] != buckets[order][:-1])
    least = docs[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.empty(len(order), dtype=bool)
    later[order] = docs[order] > least
    return np.split(later, np.cumsum(n)[:-1])


def _compactor(length: int):
    def finish(block: list[tuple]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for (_, _, rk, lo, _), later in zip(block, _later_edges(block)):
            rows += [(rk, lo + a, lo + b + length - 1) for a, b in spans.true_runs(later)]
        return spans.found_batch(rows)

    return spans.in_blocks(finish, 4, BLOCK)


def _single_edges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for doc, rk, lo, edges in zip(*(batch[c].to_pylist() for c in ("doc_id", "rk", "lo", "edges"))):
            f = np.frombuffer(edges, dtype=np.int64).reshape(-1, 2)
            fill = lambda v: np.full(len(f), v)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (f[:, 0], f[:, 1], fill(doc), fill(rk), lo + np.arange(len(f)))], schema=_EDGES_ARROW)


def repeated_spans(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """rk, start, end: word spans of each row that a smaller document holds too."""
    kept = spans.repeated(common.materialize(find_runs(docs, length), "words-runs"), by_document=True)
    classes = common.materialize(kept.groupBy("m", "f").agg(F.min("doc_id").alias("first_doc")), "words-classes")
    branching = common.materialize(classes.groupBy("m").agg(F.count("*").alias("k")).filter("k > 1"), "words-branching")
    common.release(docs.sparkSession)
    placed = kept.join(classes, ["m", "f"])
    whole = placed.filter("doc_id > first_doc").select("rk", F.col("lo").alias("start"), (F.col("lo") + F.col("n") + length - 1).alias("end"))
    firsts = placed.filter("doc_id = first_doc").join(branching, "m", "left_semi")
    paths = common.materialize(find_paths(docs, firsts, branching, length), "words-paths")
    blocks = (
        paths.filter("not crowded").select("m", "doc_id", "rk", "lo", "edges").repartition("m").sortWithinPartitions("m")
        .mapInArrow(_compactor(length), "rk long, start long, end long")
    )
    edges = paths.filter("crowded").mapInArrow(_single_edges, _EDGES)
    owners = edges.groupBy("w1", "w2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc")
    single = edges.join(owners, ["w1", "w2"]).filter("doc_id > first_doc").select("rk", F.col("at").alias("start"), (F.col("at") + length).alias("end"))
    return whole.unionByName(blocks).unionByName(single)


def _finish(ids: pa.Array, texts: pa.Array, removed: list[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    for row, data, bounds in tk.chunks(texts):
        data, bounds = tk.single_spaced(data, bounds)
        starts, ends, firsts = tk.words(data, bounds, data != 0x20)
        raw, out = data.tobytes(), []
        for d in range(len(firsts) - 1):
            lo, hi = int(firsts[d]), int(firsts[d + 1])
            at, gone, digest, kept = lo, 0, hashlib.sha256(), False
            for a, b in [*removed[row + d], (hi - lo, hi - lo)]:
                gone += b - a
                if lo + a > at:
                    digest.update((b" " if kept else b"") + raw[starts[at] : ends[lo + a - 1]])
                    kept = True
                at = lo + b
            out.append((hi - lo, gone, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([ids.slice(row, len(out)), *(pa.array(c, t.type) for c, t in zip(zip(*out), list(_OUT_ARROW)[1:]))], schema=_OUT_ARROW)


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document."""
    rows = spans.keyed(common.texts(docs, id_col, text_col))
    return spans.with_intervals(rows, repeated_spans(rows, length), _finish, _OUT)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_words(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT doc_id, p
  FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN firsts USING (h) WHERE doc_id > first_doc)),
w AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM w ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

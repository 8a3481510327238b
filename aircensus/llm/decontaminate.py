"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words (one shorter window if it has
fewer words).  The window's set elements are its ``SHINGLE``-word shingles.  They
are ordered by rarity, counted over all documents; containment of the whole
window needs every shingle, so the necessary prefix is the single rarest one.
Document positions of prefix shingles are joined with the windows; length and
positional bounds (the window must start and end inside the document) cut the
pairs, and the words themselves verify exact containment.

Documents are read twice and never shuffled with their texts.  What goes to all
tasks is a bitmap of fixed size; its false hits vanish in the join.

Nulls and empty texts have no words: they are clean, hit nothing, and as items
have no window.  Each document row gives one row, repeated rows and null ids
included; repeated items count once per item id.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import textkit as tk

WINDOW, SHINGLE = 13, 3
#: A document is contaminated if at least one in so many of its words is hit.
HIT_SHARE = 20

_ITEMS = "item_id long, size int, offset int, gram long, words string"
_ITEMS_ARROW = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("offset", pa.int32()), ("gram", pa.int64()), ("words", pa.string())])
_HITS = "rid long, doc_id long, n_words long, cands array<struct<gram:long,at:int,first:int,words:array<string>>>"
_HITS_ARROW = pa.schema([
    ("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("cands", pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.string()))]))),
])


def _grams(column: pa.Array, sizes: tuple[int, ...]):
    """For each chunk: first row, bytes, bounds, word starts, ends, first words, {size: (hashes, fits in one text)}."""
    for row, data, bounds in tk.chunks(column):
        low = tk.LOWER_LUT[data]
        starts, ends, firsts = tk.words(low, bounds, tk.ALNUM_LUT[low])
        hashes = tk.word_hashes(low, starts, ends)
        grams = {}
        for n in sizes:
            g = tk.gram_hashes(hashes, n)
            owner_end = np.repeat(firsts[1:], np.diff(firsts))[: len(g)]
            grams[n] = (g, np.arange(len(g)) + n <= owner_end)
        yield row, low, starts, ends, firsts, grams


def _item_windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window's shingles, one row per (window, offset)."""
    for batch in it:
        ids = batch["item_id"].to_pylist()
        for row, low, starts, ends, firsts, grams in _grams(batch["text"], tuple(range(1, SHINGLE + 1))):
            raw = low.tobytes()
            out = []
            for d in range(len(firsts) - 1):
                lo, n = int(firsts[d]), int(firsts[d + 1] - firsts[d])
                if not n:
                    continue
                tokens = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in range(lo, lo + n)]
                size, k = min(WINDOW, n), min(SHINGLE, n)
                for w in range(n - size + 1):
                    text = " ".join(tokens[w : w + size])
                    out += [(ids[row + d], size, o, int(common.signed(grams[k][0][lo + w + o : lo + w + o + 1])[0]), text) for o in range(size - k + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ITEMS_ARROW)], schema=_ITEMS_ARROW)


def _counter(bits, sizes: tuple[int, ...]):
    schema = pa.schema([("gram", pa.int64()), ("n", pa.int64())])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for *_, grams in _grams(batch["text"], sizes):
                for g, fits in grams.values():
                    found, n = np.unique(g[fits & common.in_bitmap(bits.value, g)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(common.signed(found)), pa.array(n)], schema=schema)

    return count


def _finder(bits, sizes: tuple[int, ...]):
    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in it:
            n_words = np.zeros(batch.num_rows, dtype=np.int64)
            cands: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for row, low, starts, ends, firsts, grams in _grams(batch["text"], sizes):
                n_words[row : row + len(firsts) - 1] = np.diff(firsts)
                for g, fits in grams.values():
                    for i in np.flatnonzero(fits & common.in_bitmap(bits.value, g)).tolist():
                        d = int(np.searchsorted(firsts, i, side="right")) - 1
                        lo, hi = max(int(firsts[d]), i - WINDOW + 1), min(int(firsts[d + 1]), i + WINDOW)
                        around = low[starts[lo] : ends[hi - 1]].tobytes()
                        tokens = [around[a:b].decode("utf-8", "replace") for a, b in zip((starts[lo:hi] - starts[lo]).tolist(), (ends[lo:hi] - starts[lo]).tolist())]
                        cands[row + d].append({"gram": int(common.signed(g[i : i + 1])[0]), "at": i - int(firsts[d]), "first": lo - int(firsts[d]), "words": tokens})
            ids = pa.array(np.arange(rid, rid + batch.num_rows), pa.int64())
            rid += batch.num_rows
            for piece in pa.Table.from_arrays([ids, batch["doc_id"], pa.array(n_words), pa.array(cands, _HITS_ARROW.field("cands").type)], schema=_HITS_ARROW).to_batches(2000):
                yield piece

    return find


def find_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, occurrences): rid, doc_id, n_words; and rid, item_id, start, size of each verified occurrence."""
    context = docs.sparkSession.sparkContext
    shingles = common.materialize(
        items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_item_windows, _ITEMS), "decon-items"
    )
    sizes = tuple(sorted(r[0] for r in shingles.select(F.least("size", F.lit(SHINGLE))).distinct().collect()))  # at most SHINGLE values
    every = common.bitmap(shingles, "gram")
    counts = docs.select("text").mapInArrow(_counter(context.broadcast(every), sizes), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rarity = shingles.select("gram").distinct().join(counts, "gram", "left").select("gram", F.coalesce("n", F.lit(0)).alias("n"))
    windows = common.materialize(
        shingles.join(rarity, "gram").groupBy("item_id", "size", "words")
        .agg(F.min(F.struct("n", "gram", "offset")).alias("rarest"))
        .filter("rarest.n > 0")
        .select("item_id", "size", F.col("rarest.gram").alias("gram"), F.col("rarest.offset").alias("offset"), F.split("words", " ").alias("window")),
        "decon-windows",
    )
    hits = common.materialize(docs.mapInArrow(_finder(context.broadcast(common.bitmap(windows, "gram")), sizes), _HITS), "decon-hits")
    # Distinct window texts are verified once, then handed to the items that hold them.
    texts = windows.groupBy("gram", "offset", "size", "window").agg(F.collect_set("item_id").alias("items"))
    start = F.col("at") - F.col("offset")
    found = (
        hits.select("rid", "n_words", F.explode("cands").alias("c")).select("rid", "n_words", "c.*")
        .join(texts, "gram")
        .filter((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .filter(F.slice("words", start - F.col("first") + 1, F.col("size")) == F.col("window"))
        .select("rid", start.alias("start"), "size", "items")
    )
    return hits.select("rid", "doc_id", "n_words"), found


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    every, found = find_windows(common.texts(docs), items)
    # Words covered: sort the occurrences of a document, add what each reaches beyond those before it.
    order = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    grow = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    spans = found.groupBy("rid").agg(order.alias("spans")).select("rid", F.aggregate("spans", start, grow)["n"].alias("n_hit"))
    names = (
        found.select("rid", F.explode("items").alias("item")).distinct()
        .groupBy("rid").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("names"))
    )
    joined = every.join(spans.join(names, "rid", "left"), "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        common.sha256(F.coalesce(F.array_join("names", ","), F.lit(""))).alias("items_sha256"),
        ((n_hit > 0) & (HIT_SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (
  SELECT rid, size, i, array_to_string(w[i : i + size - 1], ' ') AS t
  FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
occ AS (SELECT DISTINCT rid, item_id, dw.i, dw.size FROM dw JOIN win USING (t)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
        FROM (SELECT DISTINCT rid, item_id FROM occ) GROUP BY rid)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

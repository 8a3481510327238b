"""Hard negatives by exact integer products of anchor and candidate tiles.

1. Rows are packed into tiles: those of a frequent label into tiles of their own,
   others into mixed ones by the hash of their label, so that a label meets few
   tiles.  A third of all rows may have one label; its tiles stay of one size.
2. Anchor tiles meet candidate tiles in cells: one anchor tile and a stripe of
   ``STRIPE`` candidate tiles, which a task reads one after the other.  A product
   of two tiles is Strassen's recursion over int64 matrices, padded with zeros.
3. The first pass has the tiles that share a label and keeps each anchor's best
   positives in a heap, the second has the tiles with different labels and keeps
   the best negatives inside each positive's window.  Heaps of the tiles of a cell
   are merged in the task, those of an anchor's cells by a ranked window.

Scores are sums of products modulo 2**64, so they are exact where a score fits a
long.  A shorter vector counts as padded with zeros.

Rows with a null id, label or vector, or with a null or non-finite component,
take no part.  Repeated rows are rows of their own: the copy of an anchor can be
its positive and bears its id.  Ties go to the smaller id; rows that tie in both
give the same result.  Other columns are not read; without anchors, or in an
empty table, there are no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

POSITIVES, NEGATIVES = 5, 3
#: Window of a negative's score, in % of the positive's.
LOW, HIGH = 50, 95
#: Rows of an anchor tile and of a candidate tile, candidate tiles of a cell.
ANCHORS, CANDIDATES, STRIPE = 512, 1024, 8
#: Products with a side of this many rows or fewer are not split further.
PLAIN = 16
_LEAST = np.iinfo(np.int64).min

_TILE = "tile long, labels array<long>, ids binary, rows binary, owners binary, matrix binary, width int, kind string, told binary"
_TILE_ARROW = pa.schema([("tile", pa.int64()), ("labels", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("ids", "rows", "owners", "matrix")), ("width", pa.int32()), ("kind", pa.string()), ("told", pa.binary())])
_HEAP_ARROW = pa.schema([(c, pa.int64()) for c in ("row", "slot", "score", "id")])


def _product(x: np.ndarray, y: np.ndarray, levels: int) -> np.ndarray:
    if levels == 0:
        return x @ y
    m, k, n = x.shape[0] // 2, x.shape[1] // 2, y.shape[1] // 2
    a, b, c, d = x[:m, :k], x[:m, k:], x[m:, :k], x[m:, k:]
    e, f, g, h = y[:k, :n], y[:k, n:], y[k:, :n], y[k:, n:]
    below = levels - 1
    p1, p2, p3 = _product(a + d, e + h, below), _product(c + d, e, below), _product(a, f - h, below)
    p4, p5 = _product(d, g - e, below), _product(a + b, h, below)
    p6, p7 = _product(c - a, e + f, below), _product(b - d, g + h, below)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n], out[:m, n:] = p1 + p4 - p5 + p7, p3 + p5
    out[m:, :n], out[m:, n:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def strassen(x: np.ndarray, y: np.ndarray, plain: int = PLAIN) -> np.ndarray:
    """x @ y of int64 matrices, modulo 2**64: seven products of half the size, down to ``plain``."""
    levels = 0
    while min(*x.shape, y.shape[1]) >> (levels + 1) >= plain:
        levels += 1
    step = 1 << levels
    up = lambda z: np.pad(z, [(0, -s % step) for s in z.shape])
    return _product(up(x), up(y), levels)[: x.shape[0], : y.shape[1]]


def labelled_rows(vectors: DataFrame, id_col: str, vector_col: str, label, anchor, scale: int) -> DataFrame:
    """row, id, label, anchor, vec of the rows that take part; components become floor(scale * x)."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    x = F.col(vector_col).cast("array<double>")
    named = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), anchor.alias("anchor"), x.alias("vec"))
    held = named.filter("id is not null and label is not null and vec is not null").filter(F.forall("vec", fine))
    whole = held.withColumn("vec", F.transform("vec", lambda v: F.floor(v * scale).cast("long")))
    return common.materialize(whole.withColumn("row", F.monotonically_increasing_id()), "neg-rows")


def _pack(rows: pa.Table) -> pa.Table:
    """One row for all rows of a tile, ordered by id; the matrix in the narrowest type that holds it."""
    rows = rows.sort_by([("id", "ascending"), ("row", "ascending")])
    vectors = rows["vec"].combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, width = vectors.flatten().to_numpy(), int(lengths.max(initial=0))
    matrix = np.zeros((len(lengths), width), np.int64)
    matrix[np.arange(width) < lengths[:, None]] = flat
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if not matrix.size or (np.iinfo(k).min <= matrix.min() and matrix.max() <= np.iinfo(k).max))
    owners = rows["label"].to_numpy()
    told = rows["told"].combine_chunks()
    counts = np.diff(told.offsets.to_numpy())
    most = int(counts.max(initial=0))
    scores = np.zeros((2, len(counts), most), np.int64)
    scores[1] = np.arange(most) < counts[:, None]
    scores[0][scores[1] > 0] = told.flatten().to_numpy()
    raw = [np.ascontiguousarray(a, np.int64).tobytes() for a in (rows["id"].to_numpy(), rows["row"].to_numpy(), owners)]
    values = [rows["tile"][0].as_py(), np.unique(owners).tolist(), *raw, matrix.astype(kind).tobytes(), width, np.dtype(kind).name, scores.tobytes()]
    return pa.table([pa.array([v], f.type) for v, f in zip(values, _TILE_ARROW)], schema=_TILE_ARROW)


def tiles(rows: DataFrame, size: int) -> DataFrame:
    """The rows (row, id, label, vec, told) in tiles of about ``size``."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    place = F.shiftrightunsigned(F.xxhash64("label"), 1) / F.lit(2.0**63)
    own = F.xxhash64("label", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / size)))
    mixed = F.xxhash64(F.lit("mixed"), F.floor(place * F.lit(max(1, -(-rows.count() // size)))))
    named = rows.join(counts, "label").withColumn("tile", F.when(F.col("n") >= size, own).otherwise(mixed))
    return common.materialize(named.select("tile", "row", "id", "label", "vec", "told").groupBy("tile").applyInArrow(_pack, _TILE), "neg-tiles")


class _Heaps:
    """The best ``size`` entries (score, id) of each slot; equal to one heap a slot, kept as sorted arrays."""

    def __init__(self, slots: int, size: int):
        self.slots, self.size = slots, size
        self.slot, self.score, self.id = (np.empty(0, np.int64) for _ in range(3))

    def worst(self) -> np.ndarray:
        """Score that an entry must reach to come into its slot's heap."""
        first = np.searchsorted(self.slot, np.arange(self.slots + 1))
        out = np.full(self.slots, _LEAST)
        full = np.flatnonzero(np.diff(first) >= self.size)
        out[full] = self.score[first[full] + self.size - 1]
        return out

    def merge(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        slot, score, ident = np.append(self.slot, slot), np.append(self.score, score), np.append(self.id, ident)
        order = np.lexsort((ident, ~score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = place < self.size
        self.slot, self.score, self.id = slot[best], score[best], ident[best]


class _Anchors:
    """An anchor tile and its heaps while the candidate tiles of a cell go by."""

    def __init__(self, tile: dict, negatives: int | None, low: int, high: int, positives: int):
        self.rows, self.owners, self.matrix = tile["rows"], tile["owners"], tile["matrix"]
        self.negatives = negatives is not None
        n = len(self.rows)
        told = np.frombuffer(tile["told"], np.int64).reshape(2, n, -1) if n else np.zeros((2, 0, 0), np.int64)
        self.many = told.shape[2] if self.negatives else 1
        if self.negatives:  # no overflow: a multiple of 100 and the rest apart
            q, r = told[0] // 100, told[0] % 100
            self.low, self.high = low * q - (-low * r // 100), high * q + high * r // 100
            self.high[told[1] == 0], self.low[told[1] == 0] = 0, 1
        self.heaps = _Heaps(n * self.many, negatives if self.negatives else positives)

    def meet(self, tile: dict) -> None:
        width = max(self.matrix.shape[1], tile["matrix"].shape[1])
        wide = lambda z: np.pad(z.astype(np.int64), [(0, 0), (0, width - z.shape[1])])
        scores = strassen(wide(self.matrix), np.ascontiguousarray(wide(tile["matrix"]).T)) if width else np.zeros((len(self.rows), len(tile["rows"])), np.int64)
        same = self.owners[:, None] == tile["owners"]
        worst = self.heaps.worst().reshape(len(self.rows), self.many)
        if not self.negatives:
            at, who = np.nonzero(same & (self.rows[:, None] != tile["rows"]) & (scores >= worst))
            self.heaps.merge(at, scores[at, who], tile["ids"][who])
            return
        found = []
        for k in range(self.many):
            at, who = np.nonzero(~same & (scores >= np.maximum(self.low[:, k], worst[:, k])[:, None]) & (scores <= self.high[:, k][:, None]))
            found.append((at * self.many + k, scores[at, who], tile["ids"][who]))
        if found:
            self.heaps.merge(*(np.concatenate(c) for c in zip(*found)))

    def out(self) -> Iterator[pa.RecordBatch]:
        h = self.heaps
        for lo in range(0, len(h.slot), 10_000):
            slot = h.slot[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (self.rows[slot // self.many], slot % self.many, h.score[lo : lo + 10_000], h.id[lo : lo + 10_000])], schema=_HEAP_ARROW)


def _opened(row: dict) -> dict:
    out = {c: np.frombuffer(row[c], np.int64) for c in ("ids", "rows", "owners")}
    return out | {"matrix": np.frombuffer(row["matrix"], row["kind"]).reshape(len(out["ids"]), row["width"]), "told": row["told"]}


def heaps(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, negatives: int | None, low: int, high: int, positives: int) -> DataFrame:
    """row, slot, score, id: the heaps of each cell; pairs: (a, stripe, c) of tiles that meet.

    ``negatives`` None asks for positives, else for so many negatives in each positive's window.
    """
    payload = ["ids", "rows", "owners", "matrix", "width", "kind", "told"]
    left = pairs.select("a", "stripe").distinct().join(anchors.select(F.col("tile").alias("a"), *payload), "a").select("a", "stripe", F.lit(0).alias("part"), *payload)
    right = pairs.join(candidates.select(F.col("tile").alias("c"), *payload), "c").select("a", "stripe", F.lit(1).alias("part"), *payload)
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).repartition(parts, "a", "stripe").sortWithinPartitions("a", "stripe", "part")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in it:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["part"] == 0:
                    if now:
                        yield from now.out()
                    now = _Anchors(_opened(row), negatives, low, high, positives)
                else:
                    now.meet(_opened(row))
        if now:
            yield from now.out()

    return dealt.mapInArrow(run, "row long, slot long, score long, id long")


def _best(found: DataFrame, by: list[str], many: int) -> DataFrame:
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id")))
    return ranked.filter(F.col("rank") <= many)


def hard_negatives(
    vectors: DataFrame, label, anchor, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, anchor_rows: int = ANCHORS, candidate_rows: int = CANDIDATES,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` and ``anchor`` are columns of ``vectors``: the label, and whether the row is an anchor.
    """
    spark = vectors.sparkSession
    common.small_batches(spark)
    rows = labelled_rows(vectors, id_col, vector_col, label, anchor, scale)
    none = F.array().cast("array<long>")
    candidates = tiles(rows.withColumn("told", none), candidate_rows)
    stripes = max(1, -(-candidates.count() // STRIPE))
    stripe = F.pmod(F.xxhash64("c"), F.lit(stripes))
    asked = rows.filter("anchor")
    first = tiles(asked.withColumn("told", none), anchor_rows)
    sharing = first.select(F.col("tile").alias("a"), F.explode("labels").alias("label")).join(candidates.select(F.col("tile").alias("c"), F.explode("labels").alias("label")), "label")
    alike = sharing.select("a", "c").distinct().withColumn("stripe", stripe)
    best = _best(heaps(alike, first, candidates, None, low, high, positives), ["row"], positives)
    found = common.materialize(best.select("row", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "neg-positives")

    told = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))), lambda x: x["positive_score"]).alias("told"))
    second = tiles(asked.join(told, "row"), anchor_rows)
    # Every anchor tile meets every stripe of candidates, but for tiles that hold one and the same label.
    only = lambda c: F.when(F.size(c) == 1, F.get(c, 0))
    every = second.select(F.col("tile").alias("a"), only("labels").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe"))
    other = candidates.select(F.col("tile").alias("c"), only("labels").alias("y")).withColumn("stripe", stripe)
    unlike = every.join(other, "stripe").filter(~F.coalesce(F.col("x") == F.col("y"), F.lit(False))).select("a", "stripe", "c")
    kept = _best(heaps(unlike, second, candidates, negatives, low, high, positives), ["row", "slot"], negatives)
    out = kept.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(found, ["row", "slot"])
    named = out.join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(common.table(spark, sf_dir, "embeddings"), moved, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::HUGEINT FOR x IN embedding] AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.r AS ar, c.r AS cr, a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same,
    coalesce(list_sum([a.vec[i] * c.vec[i] FOR i IN range(1, least(len(a.vec), len(c.vec)) + 1)]), 0)::BIGINT AS score
  FROM v a, v c WHERE a.vec_id % 50 = 0 AND a.r <> c.r),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id, cr) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER w::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.ar, p.cr ORDER BY n.score DESC, n.id, n.cr)
QUALIFY row_number() OVER w <= 3
"""

"""Exact n-gram Jaccard join by vertical partitioning.

A document is its set of ``GRAM``-word shingles.  Documents with one set are one
node, named by a 128-bit digest of the set.

1. Sieve.  A set can only link if at least ``PERCENT`` % of its shingles occur in
   another set.  A fixed share of all shingles, chosen by hash, is counted over
   the whole corpus; a set with more shingles of its own among them than a link
   allows leaves.  Nothing that can link is lost, and most texts end here.
2. Order.  The shingles of the sets that are left are counted exactly; those of
   one set alone leave.  All others have one global order, rare ones first, ties
   by hash.
3. Candidates.  Two sets that reach the threshold share a shingle among the first
   ``n - ceil(t n) + 1`` of each, at places that leave enough shingles behind
   (prefix, length and positional bounds; none of them loses a pair).  In a few
   turns each set tries some sets before it in its lists that are not in its
   component yet, and the nearest by sketch is verified; this links large groups
   of copies with few pairs.  Then all pairs of a list that still lie in
   different components are compared; those in one component need no comparison,
   as only components are asked for.
4. Verification is vertical: the global order is cut into ``FRAGMENTS`` even
   fragments, each candidate set into its segments; the overlap of a pair is
   counted in each fragment separately and summed per pair.

A parity sketch (each shingle flips one of 8n bits or more) bounds the symmetric
difference of a pair from below and drops hopeless candidates without loss,
inside the join of the lists.  Shingles are told apart by 64-bit hashes.

Nulls and texts without words have an empty set and link with nothing.  Rows
with a null doc_id get a null component.  Rows that repeat a doc_id are judged
by their own sets.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, spans
from . import textkit as tk
from .components import connected_components

GRAM, PERCENT = 4, 85
#: Fragments of the global order.
FRAGMENTS = 8
#: Lists longer than this are walked in salted parts.
LONG_LIST = 4096
#: Turns of the first round; rows before a set that it looks at in each list, and pairs that it tries, in a turn.
TURNS, LAGS, TRIES = 2, 3, 8
#: Sixteenths of all shingles in the sieve, for each share of a set that may miss in a link.
SIEVE = 1.5

_SETS = "doc_id long, rk long, n1 long, n2 long, n long, sample array<long>"
_SETS_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "rk", "n1", "n2", "n")), ("sample", pa.list_(pa.int64()))])
_GRAMS = "n1 long, n2 long, grams array<long>, sketch array<long>"
_GRAMS_ARROW = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("grams", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def _sets(texts: pa.Array, gram: int):
    """(row, sorted distinct shingle hashes, two halves of the set's digest) of each text with a word."""
    for row, data, bounds in tk.chunks(texts):
        low = tk.LOWER_LUT[data]
        starts, ends, firsts = tk.words(low, bounds, ~tk.SPACE_LUT[low])
        words = tk.word_hashes(low, starts, ends)
        grams = tk.gram_hashes(words, gram)
        for d, (lo, hi) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
            if hi > lo:
                own = np.unique(grams[lo : hi - gram + 1] if hi - lo >= gram else tk.gram_hashes(words[lo:hi], hi - lo))
                yield row + d, own, np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype=np.int64).tolist()


def shingle_sets(docs: DataFrame, gram: int, percent: int) -> DataFrame:
    """doc_id, rk, the set's name (n1, n2; null for an empty set), its size and its shingles in the sieve."""
    share = np.uint64(min(16, int(np.ceil(16 * SIEVE * (100 - percent) / 100))))

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = batch.num_rows
            names, sizes, samples = [(None, None)] * rows, [0] * rows, [()] * rows
            for row, own, name in _sets(batch["text"], gram):
                names[row], sizes[row] = name, len(own)
                samples[row] = common.signed(own[(own & np.uint64(15)) < share])
            first, second = zip(*names) if rows else ((), ())
            for lo in range(0, rows, 2000):
                arrays = [pa.array(c[lo : lo + 2000], f.type) for c, f in zip((first, second, sizes, samples), list(_SETS_ARROW)[2:])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, 2000), batch["rk"].slice(lo, 2000), *arrays], schema=_SETS_ARROW)

    return docs.mapInArrow(emit, _SETS)


def parity_sketch(own: np.ndarray) -> np.ndarray:
    """Bits that an odd number of the set's hashes fall on; a power of two from 256 and 8n on."""
    bits = 256
    while bits < 8 * len(own):
        bits *= 2
    slot = (own >> np.uint64(3)) % np.uint64(bits)
    odd = np.bincount(slot.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def whole_sets(docs: DataFrame, alive: DataFrame, gram: int) -> DataFrame:
    """nid, n, grams, sketch of the sets of ``alive``, read again from the row that stands for each."""

    rows, wanted = common.sieve(docs, alive.select("rk"), "rk")

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(wanted, it):
            for lo in range(0, batch.num_rows, 500):
                out = [(*name, common.signed(own), parity_sketch(own)) for _, own, name in _sets(batch["text"].slice(lo, 500), gram)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _GRAMS_ARROW)], schema=_GRAMS_ARROW)

    # Rows that repeat their id and text have one key; each set is taken once.
    found = rows.drop("doc_id", "rk").mapInArrow(emit, _GRAMS).join(alive.select("nid", "n1", "n2", "n"), ["n1", "n2"])
    return found.groupBy("nid").agg(*(F.first(c).alias(c) for c in ("n", "grams", "sketch")))


def _distance(s: Column, t: Column) -> Column:
    """Differing bits of two sketches, a lower bound of the sets' symmetric difference; the longer one is folded once."""

    def fold(a, b):
        half = lambda x: F.transform(F.sequence(F.lit(0), (F.size(x) / 2).cast("int") - 1), lambda i: F.get(x, i).bitwiseXOR(F.get(x, i + (F.size(x) / 2).cast("int"))))
        return F.when(F.size(a) > F.size(b), half(a)).otherwise(a)

    return F.aggregate(F.zip_with(fold(s, t), fold(t, s), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)


def _in_reach(distance: Column, s: Column, t: Column, n: Column, m: Column, percent: int) -> Column:
    """Does the distance leave the threshold in reach?  overlap = (n + m - difference) / 2."""
    # Sizes that differ so much that one fold is not enough are out of reach anyway.
    return (F.greatest(F.size(s), F.size(t)) > 2 * F.least(F.size(s), F.size(t))) | _similar((n + m - distance) / 2, n, m, percent)


def _similar(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def possible(n, p, m, q, percent: int):
    """Can sets of n and m shingles that first meet at places p and q reach the threshold?"""
    most = F.least(n - p, m - q)
    return _similar(most, n, m, percent) & (100 * F.least(n, m) >= percent * F.greatest(n, m))


def _misses(n: Column, percent: int) -> Column:
    """Most shingles of a set of n that the other set of a link may lack."""
    return n - F.ceil(n * percent / F.lit(100)).cast("long")


def surviving(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The nodes that the sieve leaves."""
    sampled = sets.select("n1", F.explode("sample").alias("gram"))
    # The first half of the name tells sets apart here: only two similar sets that share it could be misjudged.
    alone = sampled.groupBy("gram").agg(F.min("n1").alias("n1"), F.max("n1").alias("_last")).filter("n1 = _last")
    own = alone.groupBy("n1").agg(F.count("*").alias("own"))
    return nodes.join(own, "n1", "left").filter(F.coalesce("own", F.lit(0)) <= _misses(F.col("n"), percent)).drop("own")


def ordered(whole: DataFrame, percent: int) -> DataFrame:
    """nid, n, cells: the shingles (c, gram) that other sets have too, in the global order; sets that can link only."""
    cells = whole.select("nid", F.explode("grams").alias("gram"))
    counts = cells.groupBy("gram").agg(F.count("*").alias("c")).filter("c > 1")
    shared = cells.join(counts, "gram").groupBy("nid").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("cells"))
    both = whole.select("nid", "n", "sketch").join(shared, "nid")
    return both.filter(F.col("n") - F.size("cells") <= _misses(F.col("n"), percent))


def fragment_cuts(sets: DataFrame) -> list[tuple[int, int]]:
    """(c, gram) bounds that cut the global order into ``FRAGMENTS`` about even parts."""
    place = lambda c, g: F.col(c) + (F.col(g) / 2.0**64 + 0.5)
    cells = sets.select(F.explode("cells").alias("x")).select("x.c", "x.gram")
    parts = [i / FRAGMENTS for i in range(1, FRAGMENTS)]
    cuts = cells.agg(F.percentile_approx(place("c", "gram"), F.array(*map(F.lit, parts)), F.lit(1000)).alias("p")).first()["p"] or []
    return [(int(x), int(min(max((x - int(x) - 0.5) * 2.0**64, -(2.0**63)), 2.0**63 - 1024))) for x in cuts]


def segments(sets: DataFrame, wanted: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """nid, n, fragment, grams: the segments of the sets of ``wanted``."""
    fragment = lambda x: sum((F.when((x["c"] > c) | ((x["c"] == c) & (x["gram"] >= g)), 1).otherwise(0) for c, g in cuts), F.lit(0))
    cells = sets.join(wanted, "nid", "left_semi").select("nid", "n", F.transform("cells", lambda x: F.struct(fragment(x).alias("f"), x["gram"].alias("gram"))).alias("cells"))
    numbers = F.array_distinct(F.col("cells.f"))
    return cells.select("nid", "n", "cells", F.explode(numbers).alias("fragment")).select(
        "nid", "n", "fragment", F.transform(F.filter("cells", lambda x: x["f"] == F.col("fragment")), lambda x: x["gram"]).alias("grams")
    )


def verify(pairs: DataFrame, sets: DataFrame, cuts: list[tuple[int, int]], percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose overlaps, summed over the fragments, reach the threshold."""
    pairs = common.materialize(pairs, "jac-pairs")
    named = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    found = common.materialize(segments(sets, named, cuts), "jac-segments")
    left = found.select(F.col("nid").alias("a"), "n", "fragment", F.col("grams").alias("ga"))
    right = found.select(F.col("nid").alias("b"), F.col("n").alias("m"), "fragment", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n", "m", F.size(F.array_intersect("ga", "gb")).cast("long").alias("o"))
    overlap = partial.groupBy("a", "b", "n", "m").agg(F.sum("o").alias("o"))
    links = common.materialize(overlap.filter(_similar(F.col("o"), F.col("n"), F.col("m"), percent)).select("a", "b"), "jac-links")
    common.discard(found, pairs)
    return links


def _pair(a, b):
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def prefix_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (gram, c, nid, n, pos) of the prefixes."""
    own = F.col("n") - F.size("cells")
    prefix = F.slice("cells", 1, (_misses(F.col("n"), percent) + 1 - own).cast("int"))
    rows = sets.select("nid", "n", own.alias("own"), F.posexplode(prefix).alias("i", "x"))
    return rows.select(F.col("x.gram").alias("gram"), F.col("x.c").alias("c"), "nid", "n", (F.col("own") + F.col("i")).alias("pos"))


def open_rows(lists: DataFrame, component: DataFrame | None) -> DataFrame:
    """The rows of lists that hold two components or more, with each row's component and the list's largest."""
    lists = lists.select("gram", "c", "nid", "n", "pos")
    if component is None:
        rows = lists.withColumn("component", F.col("nid"))
    else:
        rows = lists.join(component, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    sizes = rows.groupBy("gram", "component").agg(F.count("*").alias("k"))
    held = sizes.groupBy("gram").agg(F.count("*").alias("components"), F.max_by("component", F.struct("k", "component")).alias("main"))
    return common.materialize(rows.join(held.filter("components > 1").select("gram", "main"), "gram"), "jac-open")


def tried(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """At most ``TRIES`` pairs for each set: with rows before it in its lists, of other components, rarest list first.

    The first turn walks lists by size, later ones in another random order each;
    long lists are walked in parts, dealt anew each turn.
    """
    parts = F.floor(F.col("c") / LONG_LIST)
    part = F.when(parts > 1, F.pmod(F.xxhash64("nid", F.lit(turn)), parts)).otherwise(0)
    walk = W.partitionBy("gram", "part").orderBy(*(("n", "nid") if turn == 0 else (F.xxhash64("nid", F.lit(-turn)), "nid")))
    me = F.struct("nid", "n", "pos", "component")
    others = F.array(*(F.lag(me, k).over(walk) for k in range(1, LAGS + 1)), F.first(me).over(walk))
    met = rows.withColumn("part", part).select("nid", "n", "pos", "component", others.alias("o")).withColumn("o", F.explode("o"))
    o = F.col("o")
    fit = met.filter(o.isNotNull() & (o["component"] != F.col("component")) & possible(F.col("n"), F.col("pos"), o["n"], o["pos"], percent))
    best = fit.groupBy("nid", o["nid"].alias("other")).agg(F.min("pos").alias("pos"))
    chosen = best.groupBy("nid").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "other"))), 1, TRIES).alias("o"))
    return chosen.select("nid", F.explode("o.other").alias("other"))


def closest(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of each set's pairs the one with the nearest sketch that leaves the threshold in reach."""
    mine = sets.select("nid", "n", "sketch")
    theirs = sets.select(F.col("nid").alias("other"), F.col("n").alias("m"), F.col("sketch").alias("t"))
    near = pairs.join(mine, "nid").join(theirs, "other").withColumn("d", _distance(F.col("sketch"), F.col("t")))
    near = near.filter(_in_reach(F.col("d"), F.col("sketch"), F.col("t"), F.col("n"), F.col("m"), percent))
    return near.groupBy("nid").agg(F.min_by("other", "d").alias("o")).select(*_pair(F.col("nid"), F.col("o"))).distinct()


def far_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list in different components whose sketches leave the threshold in reach.

    A list's largest component is paired with the others, the others among
    themselves; what lies inside a component is never paired.
    """
    rows = rows.join(sets.select("nid", "sketch"), "nid")
    x = rows.filter("component <> main").select("gram", *(F.col(c).alias(f"x_{c}") for c in ("nid", "n", "pos", "component", "sketch")))
    once = (F.col("component") == F.col("main")) | (F.col("x_nid") < F.col("nid"))
    fits = possible(F.col("x_n"), F.col("x_pos"), F.col("n"), F.col("pos"), percent)
    s, t = F.col("x_sketch"), F.col("sketch")
    return (
        x.join(rows, "gram")
        .filter((F.col("x_component") != F.col("component")) & once & fits & _in_reach(_distance(s, t), s, t, F.col("x_n"), F.col("n"), percent))
        .groupBy(*_pair(F.col("x_nid"), F.col("nid")))
        .agg(F.min(F.struct(_distance(s, t).alias("d"), *(c.alias(x) for c, x in zip(_pair(F.col("x_component"), F.col("component")), "pq")))).alias("x"))
        .select("a", "b", "x.*")
    )


def _apart(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    of = lambda c: component.select(F.col("nid").alias(c), F.col("component").alias(f"_{c}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def similar_sets(docs: DataFrame, percent: int = PERCENT, gram: int = GRAM) -> DataFrame:
    """doc_id, rk, n_shingles, component_id, and a number of the component (null for empty sets) of each document."""
    rows = spans.keyed(docs)
    sets = common.materialize(shingle_sets(rows, gram, percent), "jac-sets")
    members = common.materialize(sets.select("doc_id", "rk", "n1", "n2", "n"), "jac-members")
    every = members.filter("n1 is not null").groupBy("n1", "n2").agg(F.min("doc_id").alias("doc_id"), F.min("rk").alias("rk"), F.min("n").alias("n"))
    nodes = common.materialize(every.withColumn("nid", F.monotonically_increasing_id()), "jac-nodes")
    alive = common.materialize(surviving(sets, nodes, percent), "jac-alive")
    common.discard(sets)
    whole = common.materialize(whole_sets(rows, alive, gram), "jac-whole")
    linkable = common.materialize(ordered(whole, percent), "jac-ordered")
    common.discard(whole)
    cuts = fragment_cuts(linkable)
    lists, component = open_rows(prefix_lists(linkable, percent), None), None

    def joined(pairs: DataFrame) -> DataFrame:
        links = verify(pairs, linkable, cuts, percent)
        if component is not None:
            links = links.unionByName(component.select(F.col("nid").alias("a"), F.col("component").alias("b")))
        return connected_components(links).withColumnRenamed("node", "nid")

    for turn in range(TURNS):
        component = joined(closest(tried(lists, turn, percent), linkable, percent))
        lists = open_rows(lists, component)
    # Of two components first the nearest pair, then all that this has not joined.
    far = common.materialize(far_pairs(lists, linkable, percent), "jac-far")
    component = joined(far.groupBy("p", "q").agg(F.min_by(F.struct("a", "b"), "d").alias("x")).select("x.*"))
    rest = common.materialize(_apart(far.select("a", "b"), component), "jac-rest")
    final = component if rest.isEmpty() else joined(rest)
    least = nodes.select("nid", "doc_id").join(final, "nid").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = final.join(least, "component").select("nid", "component_id", "component")
    found = nodes.select("nid", "n1", "n2", F.col("doc_id").alias("own_id")).join(linked, "nid", "left")
    out = members.join(found.select("n1", "n2", F.coalesce("component_id", "own_id").alias("component_id"), F.coalesce("component", "nid").alias("component")), ["n1", "n2"], "left")
    return out.select("doc_id", "rk", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), "component")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, gram: int = GRAM) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    return similar_sets(common.texts(docs, id_col, text_col), percent, gram).drop("rk", "component")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(w[i : i + 3], ' ') ELSE array_to_string(w, ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 85 * (p.n + q.n - o)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, id) AS (SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.id FROM r JOIN u ON u.a = r.doc_id WHERE r.id < u.b)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(id) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

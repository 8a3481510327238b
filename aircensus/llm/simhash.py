"""SimHash near-duplicates by a hierarchy over the Gray order of fingerprints.

1. A text's fingerprint has a bit set where over half of the XXH64 hashes of its
   shingles (repeats included) have it.  Equal fingerprints are one code.
2. Codes are sorted by Gray rank (a range partitioning) and cut into blocks, in
   which neighbours differ in few bits.  A node stands for a run of codes and
   keeps the bits that all of them share, as a mask and a pattern; nodes of
   neighbouring nodes have fewer such bits, up to one root.
3. Pairs of nodes go down the hierarchy, from the root to blocks by equi-joins
   with the children and from blocks to leaves inside a task.  The differences of
   two nodes are the differing bits that both share.  They only grow on the way
   down, so a pair with more than ``BITS`` of them is pruned with all below it.
4. Codes of the leaves that are left are compared.  Only components are asked
   for: leaves that are one component already are not compared, and a pair of
   blocks gives a spanning forest of its links instead of all of them.

Every pair of codes within ``BITS`` bits is compared or lies in one component
already, so no link between different codes is lost, and nothing is capped.

Texts without words, and nulls, have fingerprint zero and link like any other.
Rows that repeat a doc_id count by their own texts.  A row with a null doc_id
links, but gives no id: its component_id is the smallest id it reaches, null if
there is none.  Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import textkit as tk
from .components import connected_components

GRAM, BITS, SEED = 4, 4, 42
#: Most codes of a block, and how many blocks there are at least where codes allow it.
BLOCK, BLOCKS = 1 << 15, 64
#: Codes of a leaf and children of a node inside a block; children of a node above blocks (log2).
LEAF, FAN, FAN_LOG2 = 32, 8, 4
#: log2 of the blocks that one range of the sort may give.
RANGE_LOG2 = 20
#: Shingles and pairs of leaves that are worked on at once.
SLICE, LEAF_PAIRS = 1 << 16, 1 << 9


def _codes(texts: pa.Array, gram: int, seed: int) -> np.ndarray:
    """Fingerprint of each text as uint64."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for row, data, bounds in tk.chunks(texts):
        data, bounds = tk.single_spaced(tk.LOWER_LUT[data], bounds)
        starts, ends, firsts = tk.words(data, bounds, data != 0x20)
        lengths = np.diff(firsts)
        n = np.where(lengths >= gram, lengths - gram + 1, (lengths > 0).astype(np.int64))
        if not n.sum():
            continue
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + firsts[:-1][doc]
        last = at + np.minimum(lengths, gram)[doc] - 1
        raw = data.tobytes()
        counts = np.zeros((len(n), 64), np.int64)
        for lo in range(0, len(doc), SLICE):
            a, b, d = starts[at[lo : lo + SLICE]].tolist(), ends[last[lo : lo + SLICE]].tolist(), doc[lo : lo + SLICE]
            hashes = np.array([digest(raw[i:j], seed) for i, j in zip(a, b)], dtype=">u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
            new = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
            counts[d[new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
        packed = np.packbits(2 * counts > n[:, None], axis=1)
        out[row : row + len(n)] = packed.view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame, gram: int = GRAM, seed: int = SEED) -> DataFrame:
    """doc_id, code: the fingerprint of each text, its 64 bits as a long."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(common.signed(_codes(batch["text"], gram, seed)))], ["doc_id", "code"])

    return docs.mapInArrow(emit, "doc_id long, code long")


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray order, as a long that sorts like it."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def blocks(codes: DataFrame, size: int) -> DataFrame:
    """block, ones, any, codes: at most ``size`` codes that follow each other in Gray order; block numbers follow it too.

    ones has the bits that all codes of the block have set, any those that one has.
    """
    parts = max(1, -(-codes.count() // size))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left = TaskContext.get().partitionId() << RANGE_LOG2, np.empty(0, np.int64)

        def out(x: np.ndarray) -> pa.RecordBatch:
            columns = [[block], [np.bitwise_and.reduce(x)], [np.bitwise_or.reduce(x)], [x.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 3 + (pa.binary(),))], ["block", "ones", "any", "codes"])

        for batch in it:
            left = np.concatenate([left, batch["code"].to_numpy()])
            while len(left) >= size:
                yield out(left[:size])
                block, left = block + 1, left[size:]
        if len(left):
            yield out(left)

    ranked = codes.select("code", gray_rank(F.col("code")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    return common.materialize(ranked.mapInArrow(cut, "block long, ones long, any long, codes binary"), "sim-blocks")


def _nodes(cut: DataFrame, shift: int) -> DataFrame:
    """node, mask, pattern of the nodes ``shift`` bits of the block number above the blocks."""
    runs = cut.groupBy(F.shiftright("block", shift).alias("node")).agg(F.bit_and("ones").alias("ones"), F.bit_or("any").alias("any"))
    return runs.select("node", F.bitwise_not(F.col("ones").bitwiseXOR(F.col("any"))).alias("mask"), F.col("ones").alias("pattern"))


def block_pairs(cut: DataFrame, bits: int) -> DataFrame:
    """a, b (a <= b): the pairs of blocks that the nodes above them do not prune."""
    last = cut.agg(F.max("block")).first()[0] or 0
    shifts = [0, RANGE_LOG2]
    while last >> shifts[-1]:
        shifts.append(shifts[-1] + FAN_LOG2)
    root = _nodes(cut, shifts[-1])
    pairs = root.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for above, below in zip(shifts[:0:-1], shifts[-2::-1]):
        child = _nodes(cut, below)
        of = lambda side: child.select(F.shiftright("node", above - below).alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("node", "mask", "pattern")))  # noqa: B023, E731
        differ = F.col("a_pattern").bitwiseXOR(F.col("b_pattern")).bitwiseAND(F.col("a_mask")).bitwiseAND(F.col("b_mask"))
        met = pairs.join(of("a"), "a").join(of("b"), "b").filter((F.col("a_node") <= F.col("b_node")) & (F.bit_count(differ) <= bits))
        pairs = met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return pairs


def _tree(codes: np.ndarray, levels: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of each level, leaves first."""
    out, step = [], LEAF
    ones = some = codes
    for _ in range(levels):
        at = np.arange(0, len(ones), step)
        ones, some = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)
        out.append((~(ones ^ some), ones))
        step = FAN
    return out


def _leaf_pairs(x: np.ndarray, y: np.ndarray, same: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    levels = 1
    while LEAF * FAN ** (levels - 1) < max(len(x), len(y)):
        levels += 1
    left, right = _tree(x, levels), _tree(y, levels)
    p = q = np.zeros(1, np.int64)
    for level in range(levels - 1, -1, -1):
        (mask, pattern), (mask2, pattern2) = left[level], right[level]
        if level < levels - 1:
            children = np.arange(FAN)
            p, q = np.broadcast_arrays((p[:, None] * FAN + children)[:, :, None], (q[:, None] * FAN + children)[:, None, :])
            held = (p < len(mask)) & (q < len(mask2)) & ((p <= q) | (not same))
            p, q = p[held], q[held]
        near = np.bitwise_count((pattern[p] ^ pattern2[q]) & mask[p] & mask2[q]) <= bits
        p, q = p[near], q[near]
    return p, q


def _rooted(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (each the number of a node of the component) after the links (u, v)."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def forest(x: np.ndarray, y: np.ndarray, same: bool, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the codes of two sorted blocks into the components that all their links make; at most one a code."""
    p, q = _leaf_pairs(x, y, same, bits)
    every = x if same else np.concatenate([x, y])
    base = 0 if same else len(x)
    label = np.arange(len(every))
    seat = np.arange(LEAF)
    first, second = np.arange(0, len(x), LEAF), np.arange(0, len(y), LEAF)
    for lo in range(0, len(p), LEAF_PAIRS):
        a, b = p[lo : lo + LEAF_PAIRS], q[lo : lo + LEAF_PAIRS]
        mine, theirs = label[: len(x)], label[base:]
        low, low2 = np.minimum.reduceat(mine, first)[a], np.minimum.reduceat(theirs, second)[b]
        open_ = (low != low2) | (np.maximum.reduceat(mine, first)[a] != low) | (np.maximum.reduceat(theirs, second)[b] != low2)
        i, j = a[open_][:, None] * LEAF + seat, b[open_][:, None] * LEAF + seat
        there, there2 = i < len(x), j < len(y)
        i, j = np.minimum(i, len(x) - 1), np.minimum(j, len(y) - 1)
        near = np.bitwise_count(x[i][:, :, None] ^ y[j][:, None, :]) <= bits
        k, s, t = np.nonzero(near & there[:, :, None] & there2[:, None, :])
        label = _rooted(label, i[k, s], j[k, t] + base)
    moved = np.flatnonzero(label != np.arange(len(label)))
    return every[moved], every[label[moved]]


def links(codes: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links of different codes that make the components of all pairs within ``bits`` bits."""
    cut = blocks(codes, min(block, max(1024, -(-codes.count() // BLOCKS))))
    pairs = block_pairs(cut, bits)
    even = (F.col("a") + F.col("b")) % 2 == 0
    owned = pairs.select(F.when(even, F.col("a")).otherwise(F.col("b")).alias("own"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("other"))
    # Explicit partitions: the rows are small and the work on them is not.
    parts = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with_own = owned.join(cut.select(F.col("block").alias("own"), F.col("codes").alias("x")), "own").repartition(parts, "other")
    met = with_own.join(cut.select(F.col("block").alias("other"), F.col("codes").alias("y")).repartition(parts, "other"), "other")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for own, other, x, y in zip(*(batch[c].to_pylist() for c in ("own", "other", "x", "y"))):
                u, v = forest(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), own == other, bits)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(common.signed(u)), pa.array(common.signed(v))], ["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, gram: int = GRAM, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint, component_id of each document."""
    marks = common.materialize(fingerprints(common.texts(docs, id_col, text_col), gram, seed), "sim-codes")
    codes = common.materialize(marks.groupBy("code").agg(F.min("doc_id").alias("least")), "sim-distinct")
    component = connected_components(links(codes.select("code"), bits, block)).withColumnRenamed("node", "code")
    smallest = codes.join(component, "code").groupBy("component").agg(F.min("least").alias("smallest"))
    named = component.join(smallest, "component").select("code", "smallest", F.lit(True).alias("linked"))
    ids = codes.join(named, "code", "left").select("code", F.when(F.col("linked"), F.col("smallest")).otherwise(F.col("least")).alias("component_id"))
    return marks.join(ids, "code").select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(common.table(spark, sf_dir, "documents"))

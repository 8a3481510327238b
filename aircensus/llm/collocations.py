"""Collocations from depth-truncated suffix trees, built group by group.

A suffix is the words from a place of a piece on, at most ``LONGEST``.

1. Prefixes.  Words are counted, then pairs of frequent words.  A prefix of two
   words that occurs more often than ``BUDGET`` is extended by a word, and again
   while it stays too frequent, so every prefix names at most ``BUDGET``
   suffixes.  A prefix below the least count leaves: nothing that starts with it
   can be a phrase.
2. Groups.  Prefixes fall into a fixed number of slots by their hash; slots are
   packed into groups, most frequent first, up to the budget.  A group is what one
   task holds at a time.
3. Trees.  The text is read once more; each suffix goes to the group of its
   prefix, cut where a pair of words is not frequent, equal ones counted once on
   the way.  A group sorts its suffixes and so has the subtree of each prefix: a
   node is a run of suffixes that share their first words, its count the total of
   the leaves below it.  Groups know nothing of each other.
4. Scores are joins of the counted phrases with their parts, in exact decimals.

Words carry their language in their hash (64 bits), by which words are told
apart; a table of frequent words gives their text back at the end.  Bitmaps of
fixed size say what is frequent while text is read; their false hits only cost
suffixes, as counts decide at the end.

Null texts are empty, a null language is ``und``; rows that repeat count again.
A phrase that ties in score and count is placed by its text.  Other columns are
not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from . import textkit as tk

LONGEST, LEAST, TOP = 5, 100, 2000
#: Most suffixes of a prefix, and of a group but for one slot.
BUDGET = 1 << 19
#: log2 of the slots of prefixes.
SLOTS_LOG2 = 18
#: Keys that a task gathers before it counts equal ones, suffixes of a block.
GATHER, BLOCK = 1 << 19, 1 << 16

#: Bytes that part pieces, and those that part words, after lower-casing.
_CUT = np.zeros(256, dtype=bool)
_CUT[[ord(c) for c in ".,;:!?"]] = True
_CUT[10:14] = True
_WORD = ~_CUT
_WORD[[0x20, 0x09]] = False


def _tables(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def _chunks(batch: pa.RecordBatch):
    """(languages, language of each word, data, starts, ends, hashes of words, is the next word of the same piece) of each chunk."""
    langs = batch["lang"].dictionary_encode()
    names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    salt = np.array([xxhash.xxh64_intdigest(x.encode()) for x in names], np.uint64)
    for row, data, bounds in tk.chunks(batch["text"]):
        data = tk.LOWER_LUT[data]
        starts, ends, firsts = tk.words(data, bounds, _WORD[data])
        if not len(starts):
            continue
        lang = np.repeat(codes[row : row + len(bounds) - 1], np.diff(firsts))
        h = tk.mix(tk.word_hashes(data, starts, ends) ^ salt[lang])
        cuts = np.append(0, np.cumsum(_CUT[data]))
        joined = np.zeros(len(h), dtype=bool)
        joined[:-1] = cuts[starts[1:]] == cuts[ends[:-1]]
        joined[firsts[(firsts > 0) & (firsts <= len(h))] - 1] = False
        yield names, lang, data, starts, ends, h, joined


def word_counts(docs: DataFrame) -> DataFrame:
    """h, lang, word, f of every word of every language; docs: lang, text."""
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        named: dict[int, tuple[str, str]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            keys = list(counts)
            for lo in range(0, len(keys), 10_000):
                part = keys[lo : lo + 10_000]
                columns = [part, [named[k][0] for k in part], [named[k][1] for k in part], [counts[k] for k in part]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            counts.clear()
            named.clear()

        for batch in it:
            for names, lang, data, starts, ends, h, _ in _chunks(batch):
                raw = data.tobytes()
                keys, at, n = np.unique(common.signed(h), return_index=True, return_counts=True)
                for k, c, a, b, g in zip(keys.tolist(), n.tolist(), starts[at].tolist(), ends[at].tolist(), lang[at].tolist()):
                    if k in counts:
                        counts[k] += c
                    else:
                        counts[k], named[k] = c, (names[g], raw[a:b].decode())
                if len(counts) > GATHER // 4:
                    yield from flush()
        yield from flush()

    partial = docs.mapInArrow(emit, "h long, lang string, word string, f long")
    return partial.groupBy("h").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("f").alias("f"))


class _Tally:
    """Columns of keys, counted by their first column whenever there are many; they leave only if equal ones no longer make room.

    ``write`` turns the other columns and the counts into batches.
    """

    def __init__(self, write):
        self.write, self.parts, self.size = write, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            self.parts.append((*columns, np.ones(len(columns[0]), np.int64)))
            self.size += len(columns[0])
        if self.size >= GATHER:
            self._count()
            if self.size > GATHER // 2:
                yield from self.flush()

    def _count(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.argsort(columns[0], kind="stable")
        key = columns[0][order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.parts = [(*(c[order[first]] for c in columns[:-1]), np.add.reduceat(columns[-1][order], first))]
        self.size = len(first)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._count()
            (_, *columns), self.parts, self.size = self.parts[0], [], 0
            yield from self.write([common.signed(c.astype(np.uint64)) for c in columns])


def _as_rows(schema: pa.Schema):
    def write(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(columns[0]), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 20_000]) for c in columns], schema=schema)

    return write


def _as_blocks(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The suffixes of each group as blocks of whole numbers, a suffix a row; the first column is the group."""
    order = np.argsort(columns[0], kind="stable")
    group, table = columns[0][order], np.stack(columns[1:], axis=1)[order]
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)]):
        for at in range(lo, hi, BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(group[at : at + 1]), pa.array([table[at : min(hi, at + BLOCK)].tobytes()], pa.binary())], ["group", "block"])


def _longs(names: list[str]) -> tuple[str, pa.Schema]:
    return ", ".join(f"{c} long" for c in names), pa.schema([(c, pa.int64()) for c in names])


def _places(h: np.ndarray, joined: np.ndarray, words, pairs) -> np.ndarray:
    """Number of words of the suffix at each place that frequent words (and pairs, if known) allow."""
    known = common.in_bitmap(words, h)
    step = np.zeros(len(h), dtype=bool)
    step[:-1] = joined[:-1] & known[:-1] & known[1:]
    if pairs is not None and len(h) > 1:
        step[:-1] &= common.in_bitmap(pairs, tk.gram_hashes(h, 2))
    length = np.ones(len(h), np.int64)
    go = step
    for _ in range(LONGEST - 1):
        length += go
        ahead = np.zeros(len(h), dtype=bool)
        ahead[:-1] = go[1:]
        go = step & ahead
    return length


def _grams(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes at some places, all of which have ``n`` words."""
    return tk.gram_hashes(h, n)[at] if len(at) else np.empty(0, np.uint64)


def prefix_counts(docs: DataFrame, depth: int, words, pairs, over: dict) -> DataFrame:
    """w1 .. w``depth``, f: counts of prefixes of frequent words, for a depth over two only of those whose shorter ones are all over budget."""
    names = [f"w{i + 1}" for i in range(depth)]
    ddl, schema = _longs([*names, "f"])

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(_as_rows(schema))
        for batch in it:
            for *_, h, joined in _chunks(batch):
                at = np.flatnonzero(_places(h, joined, words.value, pairs.value if pairs else None) >= depth)
                for k in range(2, depth):
                    at = at[common.in_bitmap(over[k].value, _grams(h, at, k))]
                yield from tally.add(_grams(h, at, depth), *(h[at + i] for i in range(depth)))
        yield from tally.flush()

    return docs.mapInArrow(emit, ddl).groupBy(*names).agg(F.sum("f").alias("f"))


def with_hash(prefixes: DataFrame, depth: int) -> DataFrame:
    """Adds g, the hash by which tasks know a prefix."""
    names = [f"w{i + 1}" for i in range(depth)]
    ddl, schema = _longs([*names, "f", "g"])

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            flat = np.stack([batch[c].to_numpy() for c in names], axis=1).ravel().view(np.uint64)
            g = tk.gram_hashes(flat, depth)[::depth]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in (*names, "f")), pa.array(common.signed(g))], schema=schema)

    return prefixes.select(*names, "f").mapInArrow(emit, ddl)


def pack(totals: dict[int, int], budget: int) -> np.ndarray:
    """Group of each slot: slots in falling order of their totals fill one group after the other."""
    group = np.zeros(1 << SLOTS_LOG2, np.int64)
    now = filled = 0
    for slot, total in sorted(totals.items(), key=lambda x: (-x[1], x[0])):
        if filled and filled + total > budget:
            now, filled = now + 1, 0
        group[slot] = now
        filled += total
    return group


def suffixes(docs: DataFrame, words, pairs, over: dict, group) -> DataFrame:
    """group, block: the suffixes longer than their prefix, as rows of five words (0 beyond the end), number of words, words of the prefix, count."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(_as_blocks)
        for batch in it:
            for *_, h, joined in _chunks(batch):
                length = _places(h, joined, words.value, pairs.value)
                at = np.flatnonzero(length >= 3)
                g = _grams(h, at, 2)
                for p in range(2, LONGEST):
                    longer = common.in_bitmap(over[p].value, g) if p in over else np.zeros(len(at), dtype=bool)
                    here, slot = at[~longer], g[~longer] >> np.uint64(64 - SLOTS_LOG2)
                    for k in range(p + 1, LONGEST + 1):
                        mine = length[here] == k
                        i = here[mine]
                        if len(i):
                            tail = [h[i + j] if j < k else np.zeros(len(i), np.uint64) for j in range(LONGEST)]
                            yield from tally.add(_grams(h, i, k), group.value[slot[mine].astype(np.int64)], *tail, np.full(len(i), k), np.full(len(i), p))
                    at = at[longer]
                    at = at[length[at] >= p + 2]
                    g = _grams(h, at, p + 1)
        yield from tally.flush()

    return docs.mapInArrow(emit, "group long, block binary")


def subtrees(rows: pa.Table, least: int) -> pa.Table:
    """words, f: the nodes below the prefixes of a group with ``least`` occurrences or more."""
    table = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, LONGEST + 3) for b in rows["block"].to_pylist()]).T
    w, (k, p, f) = table[:LONGEST], table[LONGEST:]
    order = np.lexsort(w[::-1])
    w, k, p, f = w[:, order], k[order], p[order], f[order]
    changed = np.zeros(len(k), dtype=bool)
    changed[:1] = True
    words, counts = [], []
    for depth in range(1, LONGEST + 1):
        changed[1:] |= w[depth - 1, 1:] != w[depth - 1, :-1]
        first = np.flatnonzero(changed)
        total = np.add.reduceat(f, first)
        node = (k[first] >= depth) & (p[first] < depth) & (total >= least)
        words += w[:depth, first[node]].T.tolist()
        counts += total[node].tolist()
    return pa.table([pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.int64())], names=["words", "f"])


def phrase_counts(docs: DataFrame, counted: DataFrame, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """words (hashes), f of every phrase of up to ``LONGEST`` words with ``least`` occurrences or more.

    docs: lang, text; counted: the words of ``docs`` and their counts.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    frequent = counted.filter(F.col("f") >= least)
    words = share(common.bitmap(frequent, "h"))
    out = frequent.select(F.array("h").alias("words"), "f")
    pairs, over, totals = None, {}, None
    for depth in range(2, LONGEST + 1):
        counts = prefix_counts(docs, depth, words, pairs, over).filter(F.col("f") >= least)
        kept = common.materialize(with_hash(counts, depth), "col-prefixes")
        common.release(spark)
        out = out.unionByName(kept.select(F.array(*(f"w{i + 1}" for i in range(depth))).alias("words"), "f"))
        if depth == 2:
            pairs = share(common.bitmap(kept, "g"))
        slot = F.shiftrightunsigned("g", 64 - SLOTS_LOG2).alias("slot")
        within = kept.filter(F.col("f") <= budget).select(slot, "f")
        totals = within if totals is None else totals.unionByName(within)
        above = kept.filter(F.col("f") > budget)
        if depth == LONGEST or above.isEmpty():
            break
        over[depth] = share(common.bitmap(above, "g"))
    held = totals.groupBy("slot").agg(F.sum("f").alias("f")).toArrow()
    group = share(pack(dict(zip(held["slot"].to_pylist(), held["f"].to_pylist())), budget))
    rows = suffixes(docs, words, pairs, over, group)
    trees = rows.groupBy("group").applyInArrow(lambda t: subtrees(t, least), "words array<long>, f long")
    return out.unionByName(trees)


def _part(words: Column, start, length) -> Column:
    return F.slice(words, start, length)


def scored(phrases: DataFrame, named: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, words, a, l, r, n, score of each candidate at its lowest-scoring cut."""
    many = F.size("words")
    candidates = phrases.filter(many >= 2).join(named.select(F.col("h").alias("_h"), "lang"), F.get("words", F.lit(0)) == F.col("_h")).join(sizes, "lang")
    cuts = candidates.select("lang", "words", F.col("f").alias("a"), "n", F.explode(F.sequence(F.lit(1), many - 1)).alias("k"))
    first = cuts.withColumns({"left": _part("words", F.lit(1), F.col("k")), "right": _part("words", F.col("k") + 1, many - F.col("k"))})
    both = first.join(phrases.select(F.col("words").alias("left"), F.col("f").alias("l")), "left").join(phrases.select(F.col("words").alias("right"), F.col("f").alias("r")), "right")
    d = lambda c: F.col(c).cast("decimal(16,0)")
    both = both.withColumns({"_up": F.lit(1000).cast("decimal(4,0)") * d("a") * d("n"), "_down": d("l") * d("r")}).withColumn("score", F.expr("_up div _down"))
    best = both.groupBy("lang", "words").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "k")).alias("x"))
    return best.select("lang", "words", "x.*")


def outlived(phrases: DataFrame, percent: int) -> DataFrame:
    """words: the candidates that a longer one holds, and that occur in it ``percent`` % of the time or more."""
    many = F.size("words")
    longer = phrases.filter(many >= 3)
    part = F.flatten(F.transform(F.sequence(F.lit(2), many - 1), lambda n: F.transform(F.sequence(F.lit(1), many - n + 1), lambda i: F.slice("words", i, n))))
    held = longer.select("f", F.explode(F.array_distinct(part)).alias("words")).groupBy("words").agg(F.max("f").alias("_longer"))
    return phrases.join(held, "words").filter(100 * F.col("_longer") >= percent * F.col("f")).select("words")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, budget: int = BUDGET, percent: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to ``LONGEST`` words."""
    rows = _tables(docs, text_col, lang_col)
    counted = common.materialize(word_counts(rows), "col-words")
    sizes = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = common.materialize(phrase_counts(rows, counted, least, budget), "col-phrases")
    common.release(docs.sparkSession)
    frequent = counted.filter(F.col("f") >= least)
    kept = scored(phrases, frequent, sizes).join(outlived(phrases, percent), "words", "left_anti")
    spelt = kept.select("words", F.posexplode("words").alias("i", "h")).join(frequent.select("h", "word"), "h")
    text = spelt.groupBy("words").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.join(text, "words").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i : i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k))),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (
  SELECT x.lang, x.k, x.g, x.f AS a, n, l.f AS l, r.f AS r, (1000::HUGEINT * x.f * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k >= 2) x JOIN n USING (lang)
  JOIN f l ON l.lang = x.lang AND l.g = x.g[1 : cut] JOIN f r ON r.lang = x.lang AND r.g = x.g[cut + 1 : x.k]
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.g ORDER BY 1000::HUGEINT * x.f * n // (l.f::HUGEINT * r.f), cut) = 1),
h AS (SELECT lang, g[i : i + m - 1] AS g, max(f) AS f FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k >= 3)) GROUP BY ALL)
SELECT c.lang, row_number() OVER o AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM c LEFT JOIN h USING (lang, g) WHERE h.f IS NULL OR 100 * h.f < 100 * a
WINDOW o AS (PARTITION BY c.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) QUALIFY row_number() OVER o <= 2000
"""

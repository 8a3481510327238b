"""Quality rules with a hashed n-gram log-likelihood ratio; SQL functions only.

Base measures catch texts that are too short or repeat themselves.  The method
compares two multinomials over hashed word n-grams: a trusted target (texts
labelled good) and the raw corpus.  A document's score is the sum of its
n-grams' log ratios over their number; every document at or above the threshold
is kept, without any draw.

The target is counted on all documents labelled good, the raw corpus on all
documents.  Up to ``MOST_IDS`` ids of good texts are broadcast, so no text moves;
beyond that the same join shuffles the texts.  Ratios are whole numbers of 1/1024 nat, so sums do not depend on
their order.

Nulls and empty texts have no words, and base_failed like all short texts.  Each
row gives one row, repeated rows and null ids included; without labels the ratio
is 0 everywhere and the base rules decide.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import native_text as nt

#: n-gram orders, hash buckets, least count added to each bucket's expectation.
ORDERS, BUCKETS, SMOOTH = (1, 2), 1 << 14, 0.5
#: Units of a nat; least mean ratio kept.
UNIT, THRESHOLD = 1024, -0.1
#: Most ids of texts labelled good that are broadcast (some 64 MB in a task's table); more are joined by a shuffle.
MOST_IDS = 1 << 20
#: Bits of a packed key that hold a word's place.
_PLACE = 20


def _covered(places: Column) -> Column:
    """Words covered by 3-word windows at the given ascending places."""
    following = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.lit(1 << 30).cast("long")))
    steps = F.zip_with(places, following, lambda p, q: F.least(F.lit(3).cast("long"), q - p))
    return F.when(F.size(places) > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda s, v: s + v)).otherwise(F.lit(0).cast("long"))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words.

    Windows are sorted as packed (hash, place) numbers, and neighbours compared.
    Where two different windows share a hash, or places do not fit, the windows'
    words themselves are sorted instead.
    """
    words = F.col("words")
    top = lambda x: F.shiftright(x, _PLACE)
    place = lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1))
    packed = F.transform(
        nt.indices(words, 2), lambda i: F.shiftleft(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), _PLACE).bitwiseOR(i.cast("long"))
    )
    df = df.withColumn("_sorted", F.sort_array(packed))
    near = lambda x, j: (top(x) == top(F.get("_sorted", j - 1))) | (top(x) == top(F.get("_sorted", j + 1)))
    df = df.withColumn("_twins", F.filter("_sorted", lambda x, j: F.coalesce(near(x, j), F.lit(False))))

    def differ(x: Column, y: Column) -> Column:
        p, q = place(x).cast("int"), place(y).cast("int")
        return (top(x) == top(y)) & ~((F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2)))

    clash = F.exists(F.zip_with("_twins", F.slice("_twins", 2, F.greatest(F.size("_twins"), F.lit(1))), differ), lambda c: F.coalesce(c, F.lit(False)))
    quick = _covered(F.sort_array(F.transform("_twins", place)))
    exact = F.sort_array(F.transform(nt.indices(words, 2), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.cast("long").alias("i"))))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    # transform over a one-element array binds the sorted array once.
    slow = F.get(
        F.transform(
            F.array(exact),
            lambda s: _covered(F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False))), lambda x: x["i"]))),
        ),
        F.lit(0),
    )
    fits = F.size(words) < (1 << _PLACE)
    return df.withColumn("n_repeat_words", F.when(fits & ~clash, quick).otherwise(slow)).drop("_sorted", "_twins")


def base_measures(df: DataFrame) -> DataFrame:
    """Adds the base columns to rows of doc_id, text, words."""
    lines = F.filter(F.split("text", "\n"), lambda s: F.btrim(s, F.lit(nt.SPACES)) != "")
    df = df.withColumn("_lines", lines)
    df = df.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    ).drop("_lines")
    df = with_repeats(df)
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def ratios(prepared: DataFrame, labels: DataFrame) -> list[list[int]]:
    """For each order, the log ratio of each bucket in whole units; all counting is on the executors."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality = 1")
    ids = usable.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    # Words are made after the join, so that where ids are too many to broadcast only texts are shuffled.
    good = prepared.select("doc_id", "text").join(ids, "doc_id", "left_semi").withColumn("words", nt.words(F.col("text")))
    marked = prepared.select("words", F.lit(0).alias("target")).unionByName(good.select("words", F.lit(1).alias("target")))

    def shifted(buckets: Column, by: int) -> Column:
        return F.transform(buckets, lambda b: b + by)

    grams = F.concat(*(shifted(nt.gram_buckets(F.col("words"), n, BUCKETS), k * BUCKETS) for k, n in enumerate(ORDERS)))
    counts = marked.select("target", F.explode(grams).alias("b")).groupBy("b").agg(F.sum(1 - F.col("target")).alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros((2, len(ORDERS) * BUCKETS))
    for b, r, t in counts:  # at most one row per bucket
        raw[b], target[b] = r, t
    out = []
    for k in range(len(ORDERS)):
        r, t = raw[k * BUCKETS : (k + 1) * BUCKETS], target[k * BUCKETS : (k + 1) * BUCKETS]
        if t.sum() == 0:
            out.append([0] * BUCKETS)
            continue
        # The corpus share smooths the target: a bucket that the sample lacks costs what its absence says.
        p = (r + SMOOTH) / (r + SMOOTH).sum()
        q = (t + SMOOTH * BUCKETS * p) / (t.sum() + SMOOTH * BUCKETS)
        out.append(np.rint(UNIT * np.log(q / p)).astype(int).tolist())
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base columns, base_failed, ratio (mean log ratio of the n-grams, in units) and kept."""
    prepared = nt.prepared(docs)
    tables = ratios(prepared, labels)
    measured = base_measures(prepared)
    total, number = F.lit(0).cast("long"), F.lit(0)
    for n, values in zip(ORDERS, tables):
        total = total + nt.weigh(nt.gram_buckets(F.col("words"), n, BUCKETS), values)
        number = number + F.greatest(F.size("words") - (n - 1), F.lit(0))
    measured = measured.withColumn("_total", total).withColumn("_number", F.greatest(number, F.lit(1)))
    passes = F.col("_total") >= int(threshold * UNIT) * F.col("_number")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return measured.select(*columns, F.floor(F.col("_total") / F.col("_number")).alias("ratio"), (~F.col("base_failed") & passes).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

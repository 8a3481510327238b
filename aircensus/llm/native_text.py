"""Word columns built from SQL functions only, for the operators that run no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text that is not null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def indices(array: Column, drop: int = 0) -> Column:
    """0 .. size - 1 - drop; empty if there are none."""
    n = F.size(array) - drop
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def gram_buckets(array: Column, n: int, buckets: int) -> Column:
    """Hash bucket of each n-gram of an array of words."""
    if n == 1:
        return F.transform(array, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    return F.transform(indices(array, n - 1), lambda i: F.pmod(F.xxhash64(*(F.get(array, i + k) for k in range(n))), F.lit(buckets)).cast("int"))


def lookup(values: list[int]) -> Column:
    """A constant array of whole numbers; one literal in the plan."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def weigh(buckets: Column, values: list[int]) -> Column:
    """Sum of the values of an array of buckets."""
    constant = lookup(values)
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.get(constant, b))


def prepared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (null becomes empty), words."""
    plain = common.texts(docs, id_col, text_col)
    return plain.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words(F.col("text")))

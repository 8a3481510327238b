"""Corpus pipeline: from raw documents to a weighted training set.

Stages run in order, each on all that the one before kept; results are written
as Parquet in the shared folder and read again.  All but the last return the
columns of ``documents``; the last returns a rate per kept document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aircensus.llm import common, decontaminate, jaccard_join, mixing, pii_scan, quality_rank


def _keyed(docs: DataFrame) -> DataFrame:
    """The table with a key of id and text: rows that repeat an id are judged apart."""
    return docs.withColumn("_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that the pairwise ranking rejects."""
    score = quality_rank.scorer(docs, common.table(spark, sf_dir, "labels"))
    return docs.filter(score(F.col("text").cast("string")) >= quality_rank.CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id (then key) of each group of near copies; rows without words stay.

    Near copies share five-word shingles at a similarity of 0.8 or more, linked
    directly or through others; rows that repeat id and text are copies too.
    """
    members = jaccard_join.similar_sets(common.texts(docs), percent=80, gram=5).filter("component is not null")
    members = common.materialize(members.select("component", "rk", F.struct(F.col("doc_id").isNull(), "doc_id", "rk").alias("order")), "pipeline-members")
    first = members.groupBy("component").agg(F.min("order").alias("first"), F.count("*").alias("n")).filter("n > 1")
    grouped = members.join(first, "component")
    copies = common.materialize(grouped.filter("rk <> first.rk").select(F.col("rk").alias("_key")).distinct(), "pipeline-copies")
    twice = common.materialize(grouped.filter("rk = first.rk").groupBy(F.col("rk").alias("_key")).count().filter("count > 1").select("_key"), "pipeline-twice")
    # One sieve for both: only rows that may be copies, or stand for copies of their own key, are joined.
    clear, doubtful = common.split(_keyed(docs), copies.unionByName(twice), "_key")
    kept = doubtful.join(copies, "_key", "left_anti").select(doubtful.columns)
    if not twice.isEmpty():
        once = kept.join(twice, "_key", "left_semi").select(kept.columns).dropDuplicates(["_key"])
        kept = kept.join(twice, "_key", "left_anti").select(kept.columns).unionByName(once)
    kept = kept if clear is None else clear.unionByName(kept)
    return kept.drop("_key")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold benchmark passages."""
    keyed = _keyed(docs)
    verdicts = decontaminate.decontaminate(keyed.select(F.col("_key").alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    bad = common.materialize(verdicts.filter("contaminated").select(F.col("doc_id").alias("_key")).distinct(), "pipeline-bad")
    return common.anti(keyed, bad, "_key").drop("_key")


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the new text."""
    return pii_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A nonnegative rate for each document, with its tokens and domain posteriors."""
    return mixing.mix(docs, common.table(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("mixing_weights", mixing_weights),
]

# Learned scores and iterated rates have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

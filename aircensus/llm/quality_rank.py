"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a good document over a bad one) are drawn from a bounded
sample of labelled rows outside the held-out fold.  The model is linear: the
chance that i beats j is sigmoid(w . (x_i - x_j)), fitted by logistic loss on
the feature differences.  Documents are then ranked by w . x, and the score
quantile at which the sample errs least (bad ones count as much as good ones)
becomes the threshold; scores are shifted so that it lies at ``CUT``.

Features are style measures of the text alone.  Nulls and empty texts have
those of an empty text.  Each row gives one row, repeated rows and null ids
included; without labels of both kinds every score is 1.  Other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import features as ft
from . import textkit as tk

FOLD, HELD, CUT = 5, 0, 0.3
#: Pairs drawn for each sampled bad document; penalty of the fit.
PAIRS, L2 = 24, 1.0

_X = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])


def _vectors(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for row, data, bounds in tk.chunks(texts):
        yield row, ft.style(data, bounds)


def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for row, x in _vectors(batch["text"]):
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(x)), pa.array(list(x), _X.field("x").type)], schema=_X)


def labelled_vectors(docs: DataFrame, labels: DataFrame, column: str, fold: int, held: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the bounded sample."""
    chosen = F.broadcast(ft.sample_ids(labels, column, fold, held, rows))  # at most ``rows`` small rows
    table = docs.join(chosen, "doc_id").select("doc_id", "text", "label")
    measured = table.select("doc_id", "text").mapInArrow(_measure, "doc_id long, x array<double>").groupBy("doc_id").agg(F.max("x").alias("x"))
    got = measured.join(chosen, "doc_id").orderBy("doc_id").select("x", "label").toArrow()
    return np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(ft.STYLE)), np.array(got["label"].to_pylist(), dtype=int)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(weights, scale, shift) such that sigmoid(scale * x.w + shift) is the score."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0, 35.0
    winner = np.random.default_rng(len(y)).choice(good, len(bad) * PAIRS)
    difference = x[winner] - x[np.repeat(bad, PAIRS)]
    # Both orders of each pair, so that the loss is symmetric; the bias cancels.
    both = np.concatenate([difference, -difference])
    won = np.concatenate([np.ones(len(difference)), np.zeros(len(difference))])
    w = ft.fit_logistic(both, won, np.full(len(both), 0.5 / PAIRS), L2)
    order = np.argsort(x @ w, kind="stable")
    rank, label = (x @ w)[order], y[order]
    # Errors if the i lowest of the sample are rejected, for every quantile i / n.
    wrong = np.concatenate([[0], np.cumsum(label == 1)]) / len(good) + (len(bad) - np.concatenate([[0], np.cumsum(label == 0)])) / len(bad)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    i = int(best[len(best) // 2])
    cut = (rank[max(i - 1, 0)] + rank[min(i, len(rank) - 1)]) / 2
    # The median good document scores 0.95.
    scale = (np.log(0.95 / 0.05) - np.log(CUT / (1 - CUT))) / max(np.median(rank[label == 1]) - cut, 1e-9)
    return w, scale, float(np.log(CUT / (1 - CUT)) - scale * cut)


def scorer(docs: DataFrame, labels: DataFrame, fold: int = FOLD, held: int = HELD, rows: int = ft.SAMPLE_ROWS):
    """A function from a text column to the score column, fitted on the labelled rows of ``docs``."""
    w, scale, shift = fit(*labelled_vectors(common.texts(docs), labels, "quality", fold, held, rows))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        parts = [ft.sigmoid(scale * (x @ w) + shift) for _, x in _vectors(text)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return score


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = FOLD, held: int = HELD, rows: int = ft.SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    score = scorer(docs, labels, fold, held, rows)
    scored = common.texts(docs).select("doc_id", score("text").alias("score"))
    held_out = F.coalesce(common.crc_mod("doc_id", fold) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op7_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

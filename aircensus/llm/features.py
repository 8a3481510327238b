"""Text features and small linear models for the learned operators.

Features are computed in one vectorised pass per chunk: a few dense style
measures.  Models are fitted on a bounded sample of rows
(``SAMPLE_ROWS``), so what reaches the driver has a fixed size; scoring covers
every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import textkit as tk

#: Most labelled rows a model is fitted on: the first by hash of their id.
SAMPLE_ROWS = 12_000

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_MARKS = {"symbols": b"#*$%&|<>", "exclaim": b"!", "comma": b",", "stop": b".", "bars": b"|", "lines": b"\n", "braces": b"{}()[];=", "quotes": b"\"'"}
_MARK_LUTS = {k: np.isin(np.arange(256), list(v)) for k, v in _MARKS.items()}

STYLE = (
    "bias", "log_words", "word_bytes", "upper", "letters", "digits", *_MARKS, "upper_words", "marked_words", "long_words",
    "distinct_words", "repeat_pairs", "dup_lines", "line_words", "short",
)


def per_document(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[d]:bounds[d + 1]] for each document."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def distinct_counts(hashes: np.ndarray, owners: np.ndarray, documents: int) -> np.ndarray:
    """Distinct hashes of each document."""
    if not len(hashes):
        return np.zeros(documents, np.int64)
    order = np.lexsort((hashes, owners))
    h, o = hashes[order], owners[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=documents)


def style(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, len(STYLE)) dense features, each bounded whatever the text's length."""
    docs = len(bounds) - 1
    starts, ends, firsts = tk.words(data, bounds, ~tk.SPACE_LUT[data])
    owner = np.repeat(np.arange(docs), np.diff(firsts))
    n_words = np.diff(firsts)
    n_bytes = np.maximum(np.diff(bounds), 1)
    words = np.maximum(n_words, 1)
    hashes = tk.word_hashes(data, starts, ends)
    share = lambda lut: per_document(lut[data], bounds) / n_bytes
    of_words = lambda mask: np.bincount(owner[mask], minlength=docs) / words
    letters_before = np.concatenate([[0], np.cumsum(_LETTER[data])])
    upper_before = np.concatenate([[0], np.cumsum(_UPPER[data])])
    mark_before = np.concatenate([[0], np.cumsum(_MARK_LUTS["symbols"][data] | _MARK_LUTS["exclaim"][data])])
    n_letters = letters_before[ends] - letters_before[starts]
    n_upper = upper_before[ends] - upper_before[starts]
    pairs = tk.gram_hashes(hashes, 2)
    inside = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    n_pairs = np.maximum(n_words - 1, 1)
    line_starts, line_ends, line_firsts = tk.words(data, bounds, data != 10)
    line_owner = np.repeat(np.arange(docs), np.diff(line_firsts))
    n_lines = np.maximum(np.diff(line_firsts), 1)
    lines = tk.word_hashes(data, line_starts, line_ends)
    columns = [
        np.ones(docs), np.log1p(n_words) / 5, per_document((~tk.SPACE_LUT)[data], bounds) / words / 10,
        share(_UPPER), share(_LETTER), share(_DIGIT), *(share(lut) * 10 for lut in _MARK_LUTS.values()),
        of_words((n_letters > 1) & (n_upper * 2 > n_letters)), of_words(mark_before[ends] > mark_before[starts]), of_words(ends - starts > 15),
        distinct_counts(hashes, owner, docs) / words, 1 - distinct_counts(pairs[inside], owner[1:][inside], docs) / n_pairs,
        1 - distinct_counts(lines, line_owner, docs) / n_lines, np.log1p(n_words / n_lines) / 5, (n_words < 20).astype(float),
    ]
    return np.clip(np.column_stack(columns), 0, 4)


def sample_ids(labels: DataFrame, column: str, fold: int, held: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, label: at most ``rows`` labelled rows outside the held-out fold, the first by hash of their id."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (common.crc_mod("doc_id", fold) != held)
    )
    one = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 30) -> np.ndarray:
    """Newton steps for a dense logistic model with soft labels y; the first column is free of the penalty."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def to_numpy(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float)

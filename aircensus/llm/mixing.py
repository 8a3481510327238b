"""Mixing sources to target weights with soft membership; SQL functions only.

Domains are the classes of the labels table (quality x toxic).  A multinomial
naive Bayes model over hashed words, counted on a bounded sample of labelled
rows, predicts each document's domain posteriors, tempered by its length so that
membership stays soft.  Nonnegative document rates r are then fitted by
projected-gradient least squares:

    minimise  1/2 sum_k (A_k(r) - T_k)^2 / T_k + RIDGE/2 sum_d n_d (r_d - 1)^2,
    A_k(r) = sum_d r_d n_d p_dk,

with n_d the document's tokens, p_dk its posteriors and T_k the target tokens of
domain k.  The ridge makes the rates unique and keeps a target that no rates can
reach from piling weight on a few documents.  In the metric weighted by n_d a
document's gradient is sum_k p_dk (A_k - T_k) / T_k + RIDGE (r_d - 1): all
gradients lie in the span of the K posteriors, so the steps so far are K numbers
y and the rates their projection, r_d = max(0, 1 - sum_k p_dk y_k).  One
iteration is one aggregation of the K totals and of the K x K Gram matrix of the
rows above zero, by which the gradient is scaled; steps are halved until the
objective falls.  A handful of scans suffices, no state is kept per row, and the
driver sees some K * K numbers a scan, however many documents there are.  The fit
ends when the projected gradient vanishes, and raises if it does not;
``shortfall`` tells targets that are out of reach.

Nulls and empty texts have no tokens and keep the prior as posterior; they get a
rate like any other row.  Each row gives one row, repeated rows and null ids
included; a domain without tokens or target is left out; an empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from . import native_text as nt

#: Domains as (quality, toxic) and the share of all tokens that each should get.
DOMAINS = {"good_clean": (1, 0), "good_toxic": (1, 1), "bad_clean": (0, 0), "bad_toxic": (0, 1)}
TARGETS = {"good_clean": 0.92, "good_toxic": 0.03, "bad_clean": 0.04, "bad_toxic": 0.01}
#: Most labelled rows of the classifier, hash buckets, units of a nat, pseudo-tokens per domain.
SAMPLE_ROWS, BUCKETS, UNIT, SMOOTH = 20_000, 1 << 13, 1024, 500.0
#: Weight of staying near rate 1; largest projected gradient, as a share of all tokens, at which the fit ends; most scans.
RIDGE, TOLERANCE, SCANS = 1e-4, 1e-7, 100


def _domain(quality: Column, toxic: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, (q, t) in enumerate(DOMAINS.values()):
        out = F.when((quality == q) & (toxic == t), k).otherwise(out)
    return out


def classifier(prepared: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[list[int]], list[float]]:
    """(log likelihood of each bucket in whole units, log prior) for each domain, counted on the executors."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), _domain(F.col("quality").cast("int"), F.col("toxic").cast("int")).alias("domain"))
    chosen = usable.filter("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    marked = prepared.join(F.broadcast(chosen), "doc_id").select("domain", nt.gram_buckets(F.col("words"), 1, BUCKETS).alias("b"))
    size = {r[0]: r[1] for r in marked.groupBy("domain").count().collect()}
    seen = marked.select("domain", F.explode("b").alias("b")).groupBy("domain", "b").count().collect()  # domains x buckets at most
    counts = np.zeros((len(DOMAINS), BUCKETS))
    for k, b, n in seen:
        counts[k, b] = n
    every = counts.sum(0) + 0.5
    every /= every.sum()
    likely = np.log((counts + SMOOTH * every) / (counts.sum(1, keepdims=True) + SMOOTH))
    total = sum(size.values())
    prior = [float(np.log((size.get(k, 0) + 0.5) / (total + 0.5 * len(DOMAINS)))) for k in range(len(DOMAINS))]
    # Only differences between domains count; the mean is taken off to keep the numbers small.
    return np.rint(UNIT * (likely - likely.mean(0))).astype(int).tolist(), prior


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, p0 .. pK-1 for each document."""
    prepared = nt.prepared(docs)
    likely, prior = classifier(prepared, labels)
    hashed = prepared.select("doc_id", F.size("words").cast("long").alias("n_tokens"), nt.gram_buckets(F.col("words"), 1, BUCKETS).alias("_b"))
    sums = hashed.select("doc_id", "n_tokens", *(nt.weigh(F.col("_b"), values).alias(f"_s{k}") for k, values in enumerate(likely)))
    # Words of a text are far from independent: its evidence grows like the root of its length.
    soft = F.sqrt(F.greatest("n_tokens", F.lit(1))) * UNIT
    logits = sums.select("doc_id", "n_tokens", *((F.col(f"_s{k}") / soft + F.lit(prior[k])).alias(f"_l{k}") for k in range(len(DOMAINS))))
    top = F.greatest(*(f"_l{k}" for k in range(len(DOMAINS))))
    raised = logits.select("doc_id", "n_tokens", *(F.exp(F.col(f"_l{k}") - top).alias(f"_e{k}") for k in range(len(DOMAINS))))
    total = sum((F.col(f"_e{k}") for k in range(1, len(DOMAINS))), F.col("_e0"))
    return raised.select("doc_id", "n_tokens", *((F.col(f"_e{k}") / total).alias(f"p{k}") for k in range(len(DOMAINS))))


def _rate(y: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p{k}") * F.lit(float(v)) for k, v in enumerate(y)), F.lit(0.0)))


def _totals(members: DataFrame, y: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Tokens; sum of n r^2; domain totals A; Gram matrix of the rows whose rate is above zero."""
    ks = range(len(y))
    rows = members.withColumn("_r", _rate(y)).withColumn("_n", F.col("n_tokens").cast("double"))
    above = F.when(F.col("_r") > 0, F.col("_n")).otherwise(F.lit(0.0))
    pairs = [(i, j) for i in ks for j in ks if i <= j]
    sums = [F.col("_n"), F.col("_n") * F.col("_r") * F.col("_r"), *(F.col("_n") * F.col("_r") * F.col(f"p{k}") for k in ks), *(above * F.col(f"p{i}") * F.col(f"p{j}") for i, j in pairs)]
    got = np.array(rows.agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in sums)).first(), dtype=float)
    gram = np.zeros((len(y), len(y)))
    for (i, j), v in zip(pairs, got[2 + len(y) :]):
        gram[i, j] = gram[j, i] = v
    return got[0], got[1], got[2 : 2 + len(y)], gram


def fit_rates(members: DataFrame, targets: list[float]) -> DataFrame:
    """Adds rate: nonnegative, with expected domain totals at the targets (shares of all tokens)."""
    y = np.zeros(len(targets))
    total, square, have, gram = _totals(members, y)
    want = np.array(targets) * total
    live = np.flatnonzero((want > 0) & (np.diag(gram) > 0))
    if total == 0 or not len(live):
        return members.withColumn("rate", F.lit(1.0))
    pull = lambda y, have: (have - want - RIDGE * want * y)[live]
    cost = lambda y, square: (square / 2 + y @ want + RIDGE / 2 * (want * y) @ y) / total
    step, size, now = None, 1.0, cost(y, square)
    for _ in range(SCANS):
        g = pull(y, have)
        if np.abs(g).max() <= TOLERANCE * total:
            return members.withColumn("rate", _rate(y))
        step = np.zeros(len(y)) if step is None or size == 1.0 else step
        if size == 1.0:
            step[live] = np.linalg.solve(gram[np.ix_(live, live)] + RIDGE * np.diag(want[live]), g)
        ahead = y + size * step
        _, square, have_ahead, gram_ahead = _totals(members, ahead)
        # The cost falls along the step by its gradient, -g, at first.
        if cost(ahead, square) <= now - 1e-4 * size * (step[live] @ g) / total or size < 1e-6:
            y, have, gram, now, size = ahead, have_ahead, gram_ahead, cost(ahead, square), 1.0
        else:
            size /= 2
    raise RuntimeError(f"rates still move after {SCANS} scans")


def shortfall(mixed: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """domain, target, reached: target and expected shares of all tokens under the fitted rates; a target that is missed is out of reach."""
    shares = targets or TARGETS
    n = F.sum(F.col("n_tokens").cast("double"))
    reached = mixed.agg(n.alias("_n"), *(F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{k}")).alias(k) for k in DOMAINS))
    rows = F.array(*(F.struct(F.lit(k).alias("domain"), F.lit(shares.get(k, 0.0)).alias("target"), (F.col(k) / F.col("_n")).alias("reached")) for k in DOMAINS))
    return reached.select(F.inline(rows))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, one posterior per domain, and rate for each document."""
    shares = targets or TARGETS
    members = common.materialize(posteriors(docs, labels), "mix-members")
    fitted = fit_rates(members, [shares.get(name, 0.0) for name in DOMAINS])
    return fitted.select("doc_id", "n_tokens", *(F.col(f"p{k}").alias(f"p_{name}") for k, name in enumerate(DOMAINS)), "rate")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

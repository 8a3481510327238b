"""Toxicity by weak supervision.

Voters: single terms of a fixed lexicon, terms induced from labelled rows of the
learning folds (whole words and word beginnings, so inflected forms count),
style patterns, and one voter that fires where no term does.  A voter fires or
abstains on a document; abstaining says nothing, as each language has terms of
its own.  A generative label model (one hidden label, a firing rate of each voter under either label)
estimates the voters' accuracies by expectation-maximisation over the corpus'
vote patterns; pairs of voters that fire together more than the label explains
are correlated and share their weight.  The posterior labels of a bounded sample
of documents train a linear classifier on term and style features, which scores
every document.

Scores depend on the text alone.  Nulls and empty texts have no terms.  Each row
gives one row, repeated rows and null ids included.  Without positive labels only
the fixed lexicon and the patterns vote.  Other columns are not read.
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

FOLD, HELD, CUT = 4, 2, 0.3

# Common insults of four languages, as single-term voters.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "dumb", "scum", "trash", "loser", "losers", "pathetic", "worthless", "disgusting", "clown",
    "hate", "ugly", "retard", "bastard", "bitch", "damn", "crap", "fool", "imbecile", "filth", "vermin",
    "dumm", "idioten", "abschaum", "arschloch", "versager", "imbécile", "connard", "ordure", "crétin", "estúpido", "idiota", "basura", "imbécil",
)
#: Induced voters and linear-model terms at most; least support; least share of positives among a voter's documents.
VOTERS, TERMS, SUPPORT, PRECISION = 128, 256, 4, 0.8
#: Code points of the word beginnings that count as terms.
BEGINNINGS = (5, 7)
#: Rounds of expectation-maximisation, before and after correlations are known; prior share of toxic documents.
ROUNDS, PRIOR = 8, 0.1

_WORD_SEED, _START_SEEDS = np.uint64(0x1F), tuple(np.uint64(0x2F + 16 * i) for i in range(len(BEGINNINGS)))


def terms(data: np.ndarray, bounds: np.ndarray, known=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (term hash, document) of a chunk: words and word beginnings, only those that ``known`` lets pass."""
    low = tk.LOWER_LUT[data]
    starts, ends, firsts = tk.words(low, bounds, tk.ALNUM_LUT[low])
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(firsts))
    prefix = tk.prefix_hash(low)
    found, owners = [], []

    def take(h: np.ndarray, o: np.ndarray) -> None:
        hit = slice(None) if known is None else known(h)
        found.append(h[hit])
        owners.append(o[hit])

    take(tk.mix(tk.span_hash(prefix, starts, ends) ^ _WORD_SEED), owner)
    heads = np.flatnonzero((low & 0xC0) != 0x80)  # first bytes of code points
    first = np.searchsorted(heads, starts)
    for n, seed in zip(BEGINNINGS, _START_SEEDS):
        stop = np.append(heads, len(low))[np.minimum(first + n, len(heads))]
        long = stop <= ends
        take(tk.mix(tk.span_hash(prefix, starts[long], stop[long]) ^ seed), owner[long])
    h, o = np.concatenate(found), np.concatenate(owners)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], o[new]


def word_term(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(tk.mix(tk.word_hashes(raw, np.array([0]), np.array([len(raw)])) ^ _WORD_SEED)[0])


PATTERNS = ("shouting", "exclaiming", "no_term")


def patterns(x: np.ndarray, any_term: np.ndarray) -> np.ndarray:
    """(documents, PATTERNS) whether each style voter, and the one for no term, fires."""
    at = ft.STYLE.index
    return np.column_stack([x[:, at("upper_words")] > 0.3, x[:, at("exclaim")] > 0.2, ~any_term])


def induce(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms that mark positive rows of the sample, best first; whether each is fit to vote; the lexicon's terms that the sample does not refute."""
    schema = pa.schema([("term", pa.int64()), ("pos", pa.int64()), ("all", pa.int64())])
    table = docs.join(F.broadcast(chosen), "doc_id").select("text", "label")  # a bounded sample

    def counted(bits):
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                labels = np.array(batch["label"].to_pylist(), dtype=np.int64)
                for row, data, bounds in tk.chunks(batch["text"]):
                    h, o = terms(data, bounds, None if bits is None else lambda x: common.in_bitmap(bits.value, x))
                    one, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
                    pos = np.bincount(inverse, weights=labels[row + o], minlength=len(one)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(common.signed(one)), pa.array(pos), pa.array(n.astype(np.int64))], schema=schema)

        return run

    ddl = "term long, pos long, all long"
    total = lambda df: df.groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("all").alias("all"))
    frequent = common.materialize(total(table.filter("label = 1").mapInArrow(counted(None), ddl)).filter(F.col("pos") >= SUPPORT), "tox-frequent")
    fixed = [int(common.signed(np.array([word_term(w)], dtype=np.uint64))[0]) for w in LEXICON]
    known = frequent.select("term").unionByName(docs.sparkSession.createDataFrame([(t,) for t in fixed], "term long")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(common.bitmap(known, "term"))
    counts = total(table.mapInArrow(counted(bits), ddl)).join(known, "term", "left_semi").withColumn("share", F.col("pos") / F.col("all"))
    counts = common.materialize(counts, "tox-terms")
    ranked = counts.filter(F.col("pos") >= SUPPORT).orderBy(F.desc(F.col("share") * F.sqrt("pos")), "term").limit(TERMS).toArrow()
    refuted = {r.term for r in counts.filter(F.col("term").isin(fixed) & (F.col("all") >= SUPPORT) & (F.col("share") < PRECISION)).collect()}
    found = ranked["term"].to_numpy().view(np.uint64)
    kept = np.array([t for t in fixed if t not in refuted], dtype=np.int64).view(np.uint64)
    return found, ranked["share"].to_numpy() >= PRECISION, kept


class Voters:
    """Known terms (sorted hashes) and the voter, if any, behind each."""

    def __init__(self, found: np.ndarray, fit: np.ndarray, lexicon: np.ndarray):
        self.voters = np.unique(np.concatenate([found[fit][:VOTERS], lexicon]))
        self.terms = np.unique(np.concatenate([self.voters, found]))
        self.voter_of = np.full(len(self.terms), -1)
        self.voter_of[np.searchsorted(self.terms, self.voters)] = np.arange(len(self.voters))
        self.count = len(self.voters) + len(PATTERNS)
        # Most words miss this table of 64 K flags, so few are looked up.
        self.flags = np.zeros(1 << 16, bool)
        self.flags[self.terms >> np.uint64(48)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that are known terms."""
        maybe = np.flatnonzero(self.flags[h >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        return maybe[self.terms[at] == h[maybe]]

    def measure(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(known terms, voters that fire, style features) of each document."""
        x = ft.style(data, bounds)
        h, o = terms(data, bounds, self.known)
        at = np.searchsorted(self.terms, h)
        cuts = np.searchsorted(o, np.arange(len(bounds)))
        present = [at[a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:])]
        voted = [v[v >= 0] for v in (self.voter_of[p] for p in present)]
        style = patterns(x, np.array([len(v) > 0 for v in voted], bool))
        fired = [np.concatenate([np.sort(v), len(self.voters) + np.flatnonzero(f)]).astype(np.int32) for v, f in zip(voted, style)]
        return present, fired, x

    def matrix(self, present: list, style: np.ndarray) -> np.ndarray:
        """(documents, 1 + terms + style) features of the linear model; the first is the bias."""
        known = np.zeros((len(style), len(self.terms)))
        for i, p in enumerate(present):
            known[i, p] = 1
        return np.hstack([style[:, :1], known, style[:, 1:]])


_MEASURED = pa.schema([("doc_id", pa.int64()), ("present", pa.list_(pa.int32())), ("fired", pa.list_(pa.int32())), ("style", pa.list_(pa.float32()))])


def measured(docs: DataFrame, voters) -> DataFrame:
    """doc_id, known terms, voters that fire, style of each document: the one pass over the texts of the corpus."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row, data, bounds in tk.chunks(batch["text"]):
                present, fired, x = voters.value.measure(data, bounds)
                arrays = [pa.array(c, f.type) for c, f in zip((present, fired, list(x.astype(np.float32))), list(_MEASURED)[1:])]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(row, len(x)), *arrays], schema=_MEASURED)

    return common.materialize(docs.mapInArrow(run, "doc_id long, present array<int>, fired array<int>, style array<float>"), "tox-measured")


def _style(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(-1, len(ft.STYLE))


class LabelModel:
    """Firing rates of the voters under either label; weights that share correlated evidence."""

    def __init__(self, voters: int, prior: float):
        self.prior = prior
        self.rate = np.vstack([np.full(voters, 0.001), np.full(voters, 0.05)])  # under label 0, 1
        self.rate[:, -len(PATTERNS) : -1] = 0.02  # style alone is no evidence until it goes with terms
        self.rate[:, -1] = 0.9, 0.05  # the voter for no term
        self.weight = np.ones(voters)

    def parts(self) -> tuple[float, np.ndarray]:
        """Log odds without any vote, and what each firing voter adds."""
        return float(np.log(self.prior / (1 - self.prior))), self.weight * (np.log(self.rate[1]) - np.log(self.rate[0]))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        base, add = self.parts()
        return ft.sigmoid(base + votes @ add)

    def expected(self, table: DataFrame) -> DataFrame:
        """The vote patterns with the posterior of each."""
        base, add = self.parts()
        weights = F.array(*(F.lit(float(a)) for a in add))
        logit = F.aggregate("fired", F.lit(base), lambda s, v: s + F.get(weights, v))
        return table.withColumn("p", 1 / (1 + F.exp(-logit)))

    def step(self, table: DataFrame) -> None:
        scored = self.expected(table).select("fired", "n", (F.col("n") * F.col("p")).alias("np"))
        total, toxic = scored.agg(F.sum("n"), F.sum("np")).first()
        if not total:
            return
        fired = scored.select(F.explode("fired").alias("v"), "n", "np").groupBy("v").agg(F.sum("n"), F.sum("np")).collect()  # one row per voter
        counts = np.zeros((2, len(self.weight)))
        for v, n, p in fired:
            counts[:, v] = n - p, p
        size = np.array([[total - toxic], [toxic]])
        # A few pseudo-documents keep rates off 0 and 1; a term is never evidence against its label.
        self.rate = np.clip((counts + np.array([[0.05], [1.0]])) / (size + 10), 1e-5, 0.95)
        terms_only = slice(0, len(self.weight) - len(PATTERNS))
        self.rate[1, terms_only] = np.maximum(self.rate[1, terms_only], self.rate[0, terms_only])

    def correlate(self, table: DataFrame) -> None:
        """Share weight among voters that fire together beyond what the label explains."""
        scored = self.expected(table)
        total, toxic = scored.agg(F.sum("n"), F.sum(F.col("n") * F.col("p"))).first()
        if not total:
            return
        pairs = (
            scored.select("fired", "n", "p", F.explode("fired").alias("i")).select("n", "p", "i", F.explode("fired").alias("j")).filter("i < j")
            .groupBy("i", "j").agg(F.sum(F.col("n") * F.col("p")).alias("together")).collect()
        )  # at most one row per pair of voters
        load = np.zeros(len(self.weight))
        for i, j, together in pairs:
            a, b = self.rate[1][i], self.rate[1][j]
            rho = (together / max(toxic, 1.0) - a * b) / np.sqrt(a * (1 - a) * b * (1 - b))
            for v in (i, j):
                load[v] += min(max(rho - 0.1, 0.0), 1.0)
        self.weight = 1 / (1 + load)


def score_toxicity(docs: DataFrame, labels: DataFrame, fold: int = FOLD, held: int = HELD, rows: int = ft.SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    table = common.texts(docs)
    chosen = common.materialize(ft.sample_ids(labels, "toxic", fold, held, rows), "tox-sample")
    voters = docs.sparkSession.sparkContext.broadcast(Voters(*induce(table, chosen)))
    rows = measured(table, voters)
    # The corpus' vote patterns.
    votes = common.materialize(rows.groupBy("fired").agg(F.count("*").alias("n")), "tox-patterns")
    model = LabelModel(voters.value.count, PRIOR)
    for _ in range(ROUNDS):
        model.step(votes)
    model.correlate(votes)
    for _ in range(ROUNDS // 2):
        model.step(votes)
    w = _train(rows, chosen, voters.value, model)

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, of_term, of_style = w[0], w[1 : 1 + len(voters.value.terms)], np.append(0, w[1 + len(voters.value.terms) :])
        for batch in it:
            present = batch["present"]
            owner = np.repeat(np.arange(len(present)), np.asarray(present.value_lengths()))
            from_terms = np.bincount(owner, weights=of_term[np.asarray(present.flatten())], minlength=len(present))
            s = ft.sigmoid(bias + from_terms + _style(batch["style"]) @ of_style)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(s)], ["doc_id", "score"])

    scored = rows.select("doc_id", "present", "style").mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(common.crc_mod("doc_id", fold) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def _train(rows: DataFrame, chosen: DataFrame, voters: Voters, model: LabelModel) -> np.ndarray:
    """Weights of the linear classifier, from the posterior labels of the bounded sample."""
    got = rows.join(F.broadcast(chosen), "doc_id").select("present", "fired", "style", "label").toArrow()  # a bounded sample
    style = np.array(got["style"].to_pylist(), dtype=float).reshape(-1, len(ft.STYLE))
    x = voters.matrix([np.array(p, dtype=int) for p in got["present"].to_pylist()], style)
    if not len(x):
        w = np.zeros(x.shape[1])
        w[0] = np.log(PRIOR / (1 - PRIOR))
        return w
    votes = np.zeros((len(x), voters.count))
    for i, fired in enumerate(got["fired"].to_pylist()):
        votes[i, fired] = 1
    w = ft.fit_logistic(x, model.posterior(votes), np.ones(len(x)), 1.0)
    # The labels of the learning folds set the scale of the scores, two numbers.
    a = ft.fit_logistic(np.column_stack([np.ones(len(x)), x @ w]), ft.to_numpy(got["label"]), np.ones(len(x)), 0.1)
    w = w * max(a[1], 0.1)
    w[0] += a[0]
    return w


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))

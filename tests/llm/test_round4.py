"""near_duplicates holds one Python worker on a core: no Arrow pass reads another."""

from __future__ import annotations

import corpus_pipeline

from aircensus.llm import common, jaccard_join, spans


def passes(plan) -> int:
    """Most Arrow passes on a path of the plan, each of which holds a worker of its own."""
    below = plan.children()
    return max((passes(below.apply(i)) for i in range(below.size())), default=0) + (plan.nodeName() == "MapInArrow")


def test_sieve_runs_within_the_pass_over_texts(spark, monkeypatch):
    rows = spans.keyed(common.texts(spark.createDataFrame([(i, f"a b c d e f {i % 3} g h") for i in range(30)], "doc_id long, text string")))
    sets = jaccard_join.shingle_sets(rows, 4, 85).groupBy("n1", "n2").agg({"rk": "min", "n": "min"}).toDF("n1", "n2", "rk", "n").selectExpr("monotonically_increasing_id() AS nid", "n1", "n2", "rk", "n")
    alive = common.materialize(sets.limit(2), "alive")
    whole = jaccard_join.whole_sets(rows, alive, 4)
    assert passes(whole._jdf.queryExecution().optimizedPlan()) == 1
    found = sorted((r.nid, r.n, len(r.grams)) for r in whole.collect())
    assert len(found) == 2 and all(n == size for _, n, size in found)
    monkeypatch.setattr(common, "MOST_KEYS", 1)  # joined instead
    assert sorted((r.nid, r.n, len(r.grams)) for r in jaccard_join.whole_sets(rows, alive, 4).collect()) == found


def test_copies_and_repeated_rows_leave_in_one_pass(spark, tmp_path):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, "something else altogether in these few words"), (4, None)], "doc_id long, text string")
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert passes(kept._jdf.queryExecution().optimizedPlan()) == 1
    assert sorted((r.doc_id, r.text is None) for r in kept.collect()) == [(1, False), (3, False), (4, True)]

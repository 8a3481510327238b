"""The pipeline's stages against the operators' verdicts, and the registry of queries."""

from __future__ import annotations

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__
from aircensus.llm import common, queries


def test_stages_keep_the_columns_and_take_effect(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.materialize(stage(spark, docs, sf_dir), name)
        assert out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count(), name
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == docs.count() and last.filter("rate < 0").isEmpty()


def test_stages_by_brute_force_on_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, extra clashing columns: each stage's kept rows against plain Python."""
    import random

    from test_operators import brute_decontaminate, prose

    rng = random.Random(12)
    texts = [prose(rng, 80) for _ in range(30)]
    near = texts[3].replace(texts[3].split(" ")[40], "changed", 1)
    rows = [*enumerate(texts), (40, texts[3]), (41, near), (5, texts[6] + " tail"), (6, texts[6]), (6, texts[6]), (7, None), (None, texts[8]), (None, None), (50, ""), (51, "a@b.example and 10.0.0.1")]
    rows = [(i, t, n, "clash") for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rid long, _key string").drop("_key").withColumnRenamed("rid", "component")
    items = [(1, " ".join(texts[9].split(" ")[:40]))]
    for name, table in (("benchmark", spark.createDataFrame(items, "item_id long, text string")), ("labels", spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int"))):
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    at = str(tmp_path)
    groups: dict = {}
    linked = brute_components([(i, t) for i, t, *_ in rows])
    for n, g in enumerate(linked):
        if g is not None:
            groups.setdefault(g, []).append(n)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.component for r in stages["near_duplicates"](spark, docs, at).collect()}
    for n, (i, t, *_) in enumerate(rows):
        if linked[n] is None:
            assert n in kept
    for own in groups.values():
        left = [n for n in own if n in kept]
        ids = [rows[n][0] for n in own]
        assert len(left) == 1 and rows[left[0]][0] == min(ids, key=lambda x: (x is None, x)), own
    bad = {(d, t) for (d, t, *_), v in zip(rows, [brute_decontaminate([(d, t)], items)[0][5] for d, t, *_ in rows]) if v}
    kept = [(r.doc_id, r.text) for r in stages["benchmark_decontamination"](spark, docs, at).collect()]
    assert sorted(map(str, kept)) == sorted(str((d, t)) for d, t, *_ in rows if (d, t) not in bad) and bad
    clean = {r.component: r for r in stages["pii_redaction"](spark, docs.withColumn("n_chars", docs.doc_id), at).collect()}
    assert len(clean) == len(rows) and clean[len(rows) - 1].text == "[EMAIL] and [IP]" and clean[35].text is None
    assert stages["quality_classifier"](spark, docs, at).count() == len(rows)
    assert stages["mixing_weights"](spark, docs, at).count() == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.withColumn("n_chars", docs.doc_id).limit(0), at).count() == 0


def brute_components(rows):
    """Number of each row's group of near copies (five words, 0.8); None without words."""
    from test_operators import SPACE, low

    sets = []
    for _, t in rows:
        w = SPACE.findall(low(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    group = [n if s else None for n, s in enumerate(sets)]
    for _ in rows:
        for i, s in enumerate(sets):
            for j in range(i):
                if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                    group[i] = group[j] = min(group[i], group[j])
    return group


def test_ten_operators_are_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))

"""The stateful registry, drained under shuffled arrival, against the batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from aircensus.operators import registry as R
from aircensus.streaming import carrier
from test_registry_fold import events, scenario

FIELDS = ("rsrp", "rsrq", "rssi", "snr", "rscp", "ecio", "rxlev", "ul_freq", "bandwidth", "ta", "rrc_state", "emm_state", "emm_substate")


def rows(seed):
    """Random events in which each cell has an id of its own; the last cell id is shared by two carriers."""
    out = []
    for e in scenario(seed, 140):
        if e["kind"] == "serving" or (e["rat"] == "GSM" and e["kind"] == "neighbour"):
            continue
        if e["cid"]:
            e["cid"] = 1000 + e["freq"] * 10 + e["phy"]
        out.append(e)
    shared = [dict(kind="passport", freq=f, phy=4, mcc=250, mnc=1, tac=5, cid=77, seq=len(out) + 500 + k) for k, f in enumerate((5000, 6000))]
    return [*out, *shared]


@pytest.mark.parametrize("seed", [1, 4])
def test_the_drained_stream_equals_the_batch(spark, tmp_path, seed):
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        df = events(spark, *rows(seed)).withColumn("wall_time", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
        df.orderBy(F.rand(seed)).repartition(6).write.parquet(f"{tmp_path}/in/part=0")
        events(spark, dict(kind="radio", freq=1, phy=1, session_id=9)).withColumn("wall_time", F.timestamp_seconds(F.lit(1_800_000_000))).write.parquet(f"{tmp_path}/in/part=1")
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/in/part=*")
        out = carrier.stream_carriers(source, "1 day")
        out.writeStream.format("memory").queryName(f"k1_{seed}").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = {(r.rat, r.freq, r.phy): r for r in carrier.with_claims(carrier.latest_cells(spark.table(f"k1_{seed}"))).filter("session_id = 0").collect()}
    finally:
        spark.conf.unset(provider) if old is None else spark.conf.set(provider, old)
    want = {(r.rat, r.freq, r.phy): r for r in R.build_registry(df).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g.seen, g.mcc, g.mnc, g.plmn_soft, g.tac, g.cid) == (w.seen, w.mcc, w.mnc, w.plmn_soft, w.tac, w.cid), k
        assert [g.fields.get(f) for f in FIELDS] == [None if w[f] is None else float(w[f]) for f in FIELDS], k

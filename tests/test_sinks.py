"""Snapshots that appear whole, documents read back, sinks, byte matrices and streamed windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aircensus.operators import decode, packets, ranking, towers
from aircensus.operators import registry as R
from aircensus.sources import files
from aircensus.streaming import live
from test_registry_fold import events, gsm, lte


def test_a_snapshot_appears_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([(1,), (2,)], "x int")
    assert live.publish_batch(first, 0, path) and sorted(r.x for r in live.latest_snapshot(spark, path).collect()) == [1, 2]
    real = live._rename

    def killed(*_, **__):
        raise RuntimeError("killed between write and rename")

    monkeypatch.setattr(live, "_rename", killed)
    with pytest.raises(RuntimeError):
        live.publish_batch(spark.createDataFrame([(3,)], "x int"), 1, path)
    assert live.latest_snapshot_id(spark, path) == 0 and not (tmp_path / "out" / "batch=1").exists()
    monkeypatch.setattr(live, "_rename", real)
    assert live.publish_batch(spark.createDataFrame([(3,)], "x int"), 1, path)
    assert not live.publish_batch(spark.createDataFrame([(4,)], "x int"), 1, path)  # a repeated batch changes nothing
    assert [r.x for r in live.latest_snapshot(spark, path).collect()] == [3]


def test_a_pointer_that_was_lost_is_set_again(spark, tmp_path):
    path = str(tmp_path / "out")
    live.publish_batch(spark.range(2), 0, path)
    (tmp_path / "out" / "_latest").unlink()
    assert live.latest_snapshot_id(spark, path) is None
    assert not live.publish_batch(spark.range(2), 0, path) and live.latest_snapshot_id(spark, path) == 0


def survey(spark):
    id_ = dict(mcc=250, mnc=1, tac=5)
    return events(
        spark, lte("passport", 375, 1, cid=9, **id_), lte("serving", 375, 1), lte("neighbour", 375, 1, nb_freq=375, nb_phy=2, nb_source="intra"), lte("neighbour", 375, 1, nb_freq=375, nb_phy=2, nb_source="meas", rsrp=-90.5),
        lte("neighbour", 375, 1, nb_freq=1596, nb_phy=3, nb_source="inter"), lte("neighbour", 375, 1, nb_freq=10700, nb_source="utra"), lte("neighbour", 375, 1, nb_freq=2850, nb_source="inter"),
        lte("signal", 375, 2, rsrp=-100.0), dict(rat="WCDMA", kind="radio", freq=10700, phy=7), dict(rat="WCDMA", kind="neighbour", freq=10700, phy=7, nb_freq=10700, nb_phy=8, nb_source="wcdma", rscp=-70.0),
        gsm("radio", 40, 9), gsm("neighbour", 40, 9, nb_freq=41, nb_phy=3, nb_source="gsm", rxlev=-60.0), lte("neighbour", 375, 1, nb_freq=375, nb_phy=4, nb_source="meas", rsrp=-80.0, cgi_mcc=250, cgi_mnc=1, cgi_tac=6, cgi_cid=77),
    )


def test_neighbours_of_all_sources(spark):
    """The first source wins, a measured level goes before the registry's, a carrier without codes is a stub."""
    bound = R.bind_events(survey(spark))
    registry, told = R.registry_of_bound(bound), R.told_neighbours(bound)
    got = {(r.rat, r.nb_freq, r.nb_phy): r for r in towers.resolve_neighbours(registry, towers.with_carriers(told)).collect()}
    assert (got["LTE", 375, 2].source, got["LTE", 375, 2].nb_rsrp, got["LTE", 375, 2].resolved, got["LTE", 375, 2].reports) == ("meas", -90.5, True, 2)
    assert (got["LTE", 375, 4].nb_cid, got["LTE", 375, 4].nb_tac) == (77, 6)
    assert {k: got[k].resolved for k in (("LTE", 1596, None), ("LTE", 2850, None), ("LTE", 10700, None))} == {("LTE", 1596, None): False, ("LTE", 2850, None): False, ("LTE", 10700, None): False}
    assert [(r.freq, r.fdd) for r in ranking.bare_carriers(registry, told.filter("rat = 'LTE' and source <> 'utra'")).collect()] == [(2850, True)]


def test_wcdma_seeds_come_last(spark):
    bound = R.bind_events(survey(spark))
    got = [(r.freq, r.phy, r.rsrp) for r in ranking.rank_wcdma(R.registry_of_bound(bound), R.told_neighbours(bound)).orderBy("place").collect()]
    assert got == [(10700, 8, -70.0), (10700, 7, -160.0), (10700, 0, -158.0)]


def test_documents_and_tables_read_back(spark, tmp_path):
    bound = R.bind_events(survey(spark))
    registry, told = R.registry_of_bound(bound), R.told_neighbours(bound)
    files.write_towers_json(registry, str(tmp_path / "all"), told)
    files.write_towers_json(registry, str(tmp_path / "whole"), told, mode="complete")
    keys = lambda name: {r.key for r in files.read_towers_json(spark, str(tmp_path / name), one_a_line=True).collect()}
    assert keys("all") == {f"{r.rat}|{r.freq}|{r.phy}" for r in registry.collect()} and keys("whole") == {"LTE|375|1", "LTE|375|4"}
    near = {(r.nb_group, r.channel, r.code): (r.resolved, r.rxl) for r in files.read_tower_neighbours(spark, str(tmp_path / "all"), one_a_line=True).filter("key = 'LTE|375|1'").collect()}
    assert near == {("nb_lte", "375", "2"): ("1", "-90.5"), ("nb_lte", "375", "4"): ("1", "-80.0"), ("nb_lte", "1596", ""): ("0", ""), ("nb_lte", "1596", "3"): ("1", ""), ("nb_lte", "2850", ""): ("0", ""), ("nb_umts", "10700", ""): ("0", "")}
    files.write_cells_csv(registry, str(tmp_path / "csv"), told)
    rows = {(r.rat, r.arfcn, r.pci if r.rat != "GSM" else r.bsic): r for r in files.read_cells_csv(spark, str(tmp_path / "csv")).collect()}
    assert (rows["LTE", 375, 1].nb_lte_detail, rows["LTE", 375, 1].nb_umts_detail, rows["LTE", 375, 1].nb_lte) == ("2:-90;4:-80", "10700", 2)
    assert rows["WCDMA", 10700, 7].nb_umts_detail == "10700/8:-70" and rows["GSM", 40, 9].nb_gsm_detail == "41/3"


def test_every_sink_gets_the_result(spark):
    seen = []
    out = files.run(lambda: spark.range(3), [lambda df: seen.append(df.count()), lambda df: df.columns])
    assert seen == [3] and out == [None, ["id"]]


def test_long_payloads_do_not_widen_short_ones(spark):
    sizes = np.array([30] * 2000 + [64_000] + [29] * 2000 + [0])
    groups = list(packets.length_classes(sizes))
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(sizes)))
    assert max(len(g) * sizes[g].max() for g in groups) <= packets.MATRIX and sum(len(g) * int(max(4, sizes[g].max())) for g in groups) < 1 << 19
    held = pa.array([b"\1\2\3\4\5", None, b"", b"\7"], pa.binary())
    assert packets.byte_matrix(held).tolist() == [[1, 2, 3, 4, 5], [0] * 5, [0] * 5, [7, 0, 0, 0, 0]] and packets.byte_matrix(held.slice(3)).tolist() == [[7, 0, 0, 0]]
    rows = [(0, i, 0xB0C1, bytes.fromhex("02010077010000050000" + "4B" + "00" * (60_000 if i == 5 else 0))) for i in range(20)]
    df = spark.createDataFrame(rows, "session_id long, seq long, log_code int, payload binary")
    assert decode.decode_packets(df).select("freq", "phy", "bandwidth").distinct().collect() == [(375, 1, 15)]


@pytest.mark.parametrize(("kind", "want"), [("tumbling", {("00:00", 3), ("01:00", 1)}), ("sliding", {("23:30", 2), ("00:00", 3), ("00:30", 2), ("01:00", 1)}), ("session", {("00:10", 4)})])
def test_windows_of_packet_counts(spark, kind, want):
    times = spark.createDataFrame([(f"2026-01-02 {t}:00", 0xB0C0) for t in ("00:10", "00:20", "00:50", "01:05")], "t string, log_code int").select(F.col("t").cast("timestamp").alias("wall_time"), "log_code")
    got = {(f"{r.start:%H:%M}", r.packets) for r in live.stream_code_counts(times, kind).collect()}
    assert got == want

"""Decoders, modem text and registry rules with literal inputs."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import functions as F

from aircensus.operators import decode, modem_text, ranking
from aircensus.operators import registry as R
from aircensus.operators.packets import le
from aircensus.sources import files
from aircensus.streaming import live

SAMPLE = """
+CMGRMI: Main_Info,4,1,1,0,2,512,0,4,0
+CMGRMI: Serving_Cell,1300,262,02,4321,3,26385153,3,3,3,11,77,-98,-1003,-640,0
+CMGRMI: CA_Scell,39150,12,40,5,0,12,-105,-870,-700,0,0,0
+CMGRMI: LTE_Intra,1,1300,77,1
+CMGRMI: LTE_Intra_Cell1,77,-98,-1003,-640,0
+CMGRMI: LTE_Inter,2,Freq1,39150,2,0,0,0,Freq2,6300,2,0,0,0
+CMGRMI: LTE_InterFreq1_Cell1,12,-105,-870,-700,0
+CMGRMI: LTE_InterFreq1_Cell2,301,-140,-1022,-711,0
+CMGRMI: LTE_InterFreq2_Cell1,9,-111,-955,-690,0
OK
"""
EVENTS = "session_id long, seq long, wall_time timestamp, rat string, kind string, freq int, phy int, mcc int, mnc int, tac int, cid long, rsrp double, nb_freq int, nb_phy int, nb_source string"


def events(spark, *rows):
    base = {c.split()[0]: None for c in EVENTS.split(", ")} | {"session_id": 0, "rat": "LTE"}
    return spark.createDataFrame([tuple((base | {"seq": i + 1} | r).values()) for i, r in enumerate(rows)], EVENTS)


def cells(df):
    return {(r.freq, r.phy): r for r in df.collect()}


def packets(spark, *rows):
    return spark.createDataFrame([(0, i, code, bytes.fromhex(h)) for i, (code, h) in enumerate(rows)], "session_id long, seq long, log_code int, payload binary")


def test_golden_packets(spark):
    rows = packets(
        spark,
        (0xB0C2, "039C0077010000C74700004B4B19DF16038E4501000000FA0002010000"), (0xB0C2, "024800640AB4504B3267452301AB0007000000FA0002010000"),
        (0xB17F, "05010000C8000000D20F00009DD559009DD559000001041000B90C004AAD7E020000000010130000"), (0xB114, "A11404000000E07700780000E0EF0000"),
        (0x4027, "f1250000a729000041852d0800000700d01802060200030f9d9c000001000000"), (0xB822, "0000020050010eb005001e036a1b0c"), (0xB0C2, "09"), (0x1234, "00"),
    )
    got = {(r.seq, r.kind): r for r in decode.decode_packets(rows).collect()}
    a = got[0, "passport"]
    assert (a.freq, a.phy, a.cid, a.tac, a.mcc, a.mnc) == (375, 156, 51830553, 17806, 250, 1) and got[0, "radio"].ul_freq == 18375
    b = got[1, "passport"]
    assert (b.freq, b.phy, b.cid, b.tac, b.mcc, b.mnc) == (2660, 72, 0x01234567, 171, 250, 1)
    assert (got[2, "signal"].freq, got[2, "signal"].phy) == (200, 466) and abs(got[2, "signal"].rsrp + 90) < 0.5
    assert got[3, "radio"].ta == 2
    w = got[4, "passport"]
    assert (w.freq, w.ul_freq, w.phy, w.cid, w.tac, w.mcc, w.mnc) == (10663, 9713, 397, 0x082D8541, 0x9C9D, 262, 3)
    assert (got[5, "radio"].freq, got[5, "radio"].phy) == (372750, 336)
    assert not any(s in (6, 7) for s, _ in got)


def test_a_decoder_of_the_program_reaches_the_workers(spark, monkeypatch):
    monkeypatch.delitem(decode.DECODERS, 0x7A01, raising=False)

    @decode.register_decoder(0x7A01, "GSM")
    def _own(b, n):
        return [("radio", n >= 4, {"freq": le(b, 0, 2), "phy": le(b, 2, 2)})]

    got = decode.decode_packets(packets(spark, (0x7A01, "10000500"), (0x7A01, "10"), (0x7A02, "10000500"))).collect()
    assert [(r.rat, r.freq, r.phy) for r in got] == [("GSM", 16, 5)]


def test_cmgrmi_sample(spark):
    df = spark.createDataFrame([(0, 1, SAMPLE), (0, 2, "+CMGRMI: Serving_Cell,4294967295,65535,65535,0,0,0,0,0,0,0,0,0,0,0"), (0, 3, None)], "session_id long, seq long, reply string")
    got = {(r.earfcn, r.pci): r for r in modem_text.parse_cmgrmi(df).collect()}
    s = got[1300, 77]
    assert (s.kind, s.tac, s.ta, s.dl_bw, s.cid, s.rsrp, s.rsrq) == ("serving", 4321, 3, 10, 26385153, -100.3, -9.8)
    assert got[39150, 12].rsrp == -87.0 and set(got) == {(1300, 77), (39150, 12), (39150, 301), (6300, 9)}


def test_short_replies(spark):
    rows = [
        (0, 1, "+CPSI: LTE,Online,262-02,0x10E1,26385153,77,EUTRAN-BAND3,1300,4,4,-98,-1003,-640,11"),
        (0, 2, "+CPSI: WCDMA,Online,262-02,0x10E1,1234567,WCDMA IMT 2000,101,10700,0,6.5,81,30,40,500"), (0, 3, "+CEREG: 2,1,10E1,1929A41,7"), (0, 4, '+COPS: 0,2,"26202",7'),
    ]
    df = spark.createDataFrame(rows, "session_id long, seq long, reply string")
    cpsi = {r.seq: r for r in modem_text.parse_cpsi(df).collect()}
    assert (cpsi[1].tac, cpsi[1].cid, cpsi[1].freq, cpsi[1].phy, cpsi[1].level) == (0x10E1, 26385153, 1300, 77, -100.3)
    assert (cpsi[2].phy, cpsi[2].freq, cpsi[2].level) == (101, 10700, -35.0)
    assert [(r.tac, r.cid) for r in modem_text.parse_cereg(df).collect()] == [(0x10E1, 0x1929A41)]
    assert [(r.mcc, r.mnc) for r in modem_text.parse_cops(df).collect()] == [(262, 2)]


def test_registry_rules(spark):
    first_kept = cells(R.build_registry(events(spark, dict(kind="passport", freq=6250, phy=100, mcc=262, mnc=2, tac=111, cid=0x0ABC123), dict(kind="passport", freq=6250, phy=100, mcc=262, mnc=20, tac=222, cid=0x0DEF456))))
    assert (first_kept[6250, 100].tac, first_kept[6250, 100].mnc) == (111, 2)
    weak = cells(R.build_registry(events(spark, dict(kind="passport", freq=2950, phy=0, mcc=262, mnc=20), dict(kind="radio", freq=2950, phy=311))))
    assert set(weak) == {(2950, 311)} and weak[2950, 311].mnc == 20
    spread = cells(R.build_registry(events(spark, dict(kind="radio", freq=2950, phy=10), dict(kind="radio", freq=2950, phy=20), dict(kind="passport", freq=2950, phy=0, mcc=262, mnc=45))))
    assert {k: v.mnc for k, v in spread.items()} == {(2950, 10): 45, (2950, 20): 45}
    stripped = cells(R.build_registry(events(spark, dict(kind="passport", freq=6250, phy=0, mcc=262, mnc=1, tac=5, cid=77))))
    assert stripped[6250, 0].cid is None and stripped[6250, 0].mcc == 262
    soft = cells(R.build_registry(events(spark, dict(kind="radio", freq=6250, phy=88), dict(kind="passport", freq=6250, phy=205, mcc=262, mnc=20, tac=5, cid=9))))
    assert soft[6250, 88].plmn_source == "fanout" and soft[6250, 88].mnc == 20 and soft[6250, 88].cid is None
    owner = cells(R.build_registry(events(spark, dict(kind="passport", freq=6250, phy=17, mcc=262, mnc=20, tac=5, cid=9), dict(kind="passport", freq=6250, phy=205, mcc=262, mnc=20, tac=5, cid=9))))
    assert owner[6250, 205].cid == 9 and owner[6250, 17].cid is None and owner[6250, 17].mcc == 262
    serving = cells(R.build_registry(events(spark, dict(kind="serving", freq=100, phy=1), dict(kind="serving", freq=100, phy=2), dict(kind="passport", freq=100, phy=2, mcc=262, mnc=1, tac=3, cid=4))))
    assert (serving[100, 1].is_serving, serving[100, 1].ever_serving) == (False, False) and (serving[100, 2].is_serving, serving[100, 2].ever_serving) == (True, True)


def fold_session(events):
    """Ordered fold over one session's events (a pandas frame): the exact rules, for cross-checks."""
    cells: dict[tuple, dict] = {}
    serving: dict[str, tuple] = {}

    def cell(key):
        return cells.setdefault(key, {"seen": 0, "rsrp": None, "is_serving": False})

    for e in events.sort_values("seq").itertuples():
        key = (e.rat, e.freq, e.phy)
        if e.kind == "neighbour":
            continue
        c = cell(key)
        c["seen"] += 1
        if e.kind == "signal" and -150 <= e.rsrp <= -40:
            c["rsrp"] = e.rsrp
        if e.kind == "serving":
            if e.rat in serving:
                cells[serving[e.rat]]["is_serving"] = False
            serving[e.rat] = key
            c["is_serving"] = True
    rows = [(*k, c["seen"], c["rsrp"], c["is_serving"]) for k, c in cells.items()]
    return pd.DataFrame(rows, columns=["rat", "freq", "phy", "seen", "rsrp", "is_serving"])


def test_registry_equals_the_ordered_fold_whatever_the_partitioning(spark):
    rng = random.Random(1)
    rows = [dict(kind=rng.choice(["radio", "signal", "serving"]), freq=rng.choice([375, 1596]), phy=rng.randrange(1, 6), rsrp=rng.randrange(-170, -30) / 1.0) for _ in range(200)]
    df = events(spark, *rows)
    want = fold_session(pd.DataFrame([r.asDict() for r in df.collect()]))
    want = {(r.freq, r.phy): (r.seen, r.rsrp, r.is_serving) for r in want.itertuples()}
    for parts in (1, 5):
        got = {k: (r.seen, r.rsrp, r.is_serving) for k, r in cells(R.build_registry(df.repartition(parts).orderBy(F.rand(3)))).items()}
        assert {k: (a, None if b is None or b != b else b, c) for k, (a, b, c) in want.items()} == got


def test_empty_events(spark):
    assert R.build_registry(events(spark)).count() == 0


def test_packing_vote_locks(spark):
    words = spark.createDataFrame([(0, i, w) for i, w in enumerate([0x0FD2, 0x03D2, 0x0FEB, 0x2400])], "session_id long, seq long, word int")
    got = {r.seq: r for r in ranking.vote_packing(words).collect()}
    assert got[1].locked is None and got[2].locked == "LSB" and [got[i].pci for i in range(3)] == [466, 466, 491]


def test_streamed_cells_follow_the_rules_of_the_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [dict(kind=rng.choice(["radio", "signal", "serving"]), freq=rng.choice([375, 1596]), phy=rng.randrange(1, 6), rsrp=rng.randrange(-170, -30) / 1.0) for _ in range(120)]
    df = events(spark, *rows)
    wanted = {k: (r.seen, r.rsrp, r.is_serving) for k, r in cells(R.build_registry(df)).items()}
    timed = df.withColumn("wall_time", F.timestamp_seconds(F.col("seq") + 1_700_000_000))
    timed.orderBy(F.rand(2)).repartition(6).write.parquet(f"{tmp_path}/in")

    def drain(stream, name):
        stream.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    told = drain(live.stream_cells(source), "k1_cells").groupBy(*R.KEY, "period").agg(F.max_by(F.struct("rsrp", "seen"), "seen").alias("c")).select(*R.KEY, "period", "c.*")
    assert told.count() == len(wanted)
    emitted = {(r.session_id, r.rat, r["at"]) for r in drain(live.stream_serving(source), "k1_serving").collect()}
    assert {(r.session_id, r.rat, r["at"]) for r in live.stream_serving(timed, None).collect()} <= emitted
    got = {(r.freq, r.phy): (r.seen, r.rsrp, r.is_serving) for r in live.with_serving(told.drop("period"), live.stream_serving(timed, None)).collect()}
    assert got == wanted


def test_journal_pairs_lines_across_blocks(spark, tmp_path):
    text = "RAW: 01\n" + "".join(f"[2026-01-02 03:04:05] rx 0xB0C{i % 9} EARFCN={i} pci={i % 504} pdu={i}\n# note {i}\n\n  RAW: {i % 256:02X} AB\n" + ("RAW: 00\n" if i % 5 == 0 else "") + ("0xB0C1 x\nRAW: zz\n" if i % 7 == 0 else "") for i in range(300))
    (tmp_path / "journal.txt").write_text(text)
    want, errors, head = [], [], None
    for n, line in enumerate(text.split("\n")):
        if line.strip().startswith("RAW:"):
            body = line.split(":", 1)[1].replace(" ", "")
            if head and body != "zz":
                want.append((len(want) + 1, int(head.split("pdu=")[1]), body))
            else:
                errors.append((n, line))
            head = None
        elif "0x" in line:
            head = line
    key, small = "spark.sql.files.maxPartitionBytes", 700
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, small)
        packets, bad = files.read_journal(spark, str(tmp_path / "journal.txt"))
        assert spark.read.text(str(tmp_path / "journal.txt")).rdd.getNumPartitions() > 5
        assert sorted((r.seq, r.hdr_pdu, r.payload.hex().upper()) for r in packets.collect()) == want
        assert sorted((r.line_no, r.line) for r in bad.collect()) == errors
    finally:
        spark.conf.set(key, old)

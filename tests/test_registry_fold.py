"""The registry in set form against an ordered fold in plain Python, on random events with conflicts, and literal cases of each rule."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from aircensus.operators import registry as R

COLUMNS = (
    "session_id long, seq long, sub_seq int, wall_time timestamp, ts_ticks long, rat string, kind string, freq int, phy int, mcc int, mnc int, tac int, cid long, mnc_digits int, rac int, barred boolean, "
    "rsrp double, rsrq double, rssi double, snr double, rscp double, ecio double, rxlev double, ul_freq int, bandwidth int, ta int, rrc_state int, emm_state int, emm_substate int, "
    "barring_emergency boolean, nb_freq int, nb_phy int, nb_source string, nb_offset int, nb_thresh_high int, cgi_mcc int, cgi_mnc int, cgi_tac int, cgi_cid long"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def events(spark, *rows):
    base = dict.fromkeys(NAMES) | {"session_id": 0, "rat": "LTE", "sub_seq": 0}
    return spark.createDataFrame([tuple((base | {"seq": i + 1} | r)[c] for c in NAMES) for i, r in enumerate(rows)], COLUMNS)


def cells(df):
    return {(r.rat, r.freq, r.phy): r for r in df.collect()}


def lte(kind, freq, phy, **more):
    return dict(kind=kind, freq=freq, phy=phy, **more)


# ---- the fold ----------------------------------------------------------------------------------


def _eci(x):
    return x is not None and 1 <= x <= 0x0FFFFFFF


def _tac(x):
    return x is not None and 1 <= x <= 0xFFFE


class Fold:
    """One session, event by event."""

    def __init__(self):
        self.cells, self.serving = {}, {}

    def cell(self, key):
        return self.cells.setdefault(key, {"seen": 0, "cid": None, "tac": None, "plmn": None, "soft": False, "ever": False, "barred": None, "digits": None, "levels": {}, "radio": {}, "level_known": False})

    def full(self, c):
        return c["cid"] is not None and c["tac"] is not None and c["plmn"] is not None

    def merge(self, c, e):
        plmn = (e["mcc"], e["mnc"]) if e["mcc"] else None
        full, before = _eci(e["cid"]) and _tac(e["tac"]) and plmn is not None, self.full(c)
        win = full and not before
        if _eci(e["cid"]) and (c["cid"] is None or win):
            c["cid"] = e["cid"]
        if plmn:
            if c["plmn"] is None or win or c["soft"]:
                c["plmn"], c["soft"] = plmn, False
        if _tac(e["tac"]) and (c["tac"] is None or win):
            c["tac"] = e["tac"]
        if e.get("mnc_digits") in (2, 3):
            c["digits"] = e["mnc_digits"]
        if full or (not before and (_eci(e["cid"]) or plmn)):
            c["barred"] = e.get("barred")

    def claim(self, key, cid):
        for k, c in self.cells.items():
            if k[0] == "LTE" and k != key and c["cid"] == cid:
                c["cid"] = c["tac"] = None

    def fan_out(self, freq, plmn):
        for k, c in self.cells.items():
            if k[0] == "LTE" and k[1] == freq and k[2] and c["plmn"] is None:
                c["plmn"], c["soft"] = plmn, True

    def level(self, key, e):
        c = self.cell(key)
        c["level_known"] = True
        keep = lambda f, ok: c["levels"].update({f: e[f]}) if ok else None
        has = lambda f: e[f] is not None
        if key[0] == "LTE":
            keep("rsrp", has("rsrp") and -150 <= e["rsrp"] <= -40)
            keep("rsrq", has("rsrq") and -30 <= e["rsrq"] <= -1)
            keep("rssi", has("rssi"))
            keep("snr", has("snr"))
        elif key[0] == "NR":
            c["levels"] = {f: e[f] for f in ("rsrp", "rsrq", "snr")}
        elif key[0] == "WCDMA":
            keep("rsrp", has("rsrp") and -150 <= e["rsrp"] <= -40)
            keep("rscp", has("rscp") and e["rscp"] != 0)
            keep("ecio", has("ecio"))
        else:
            keep("rsrp", has("rsrp") and -150 <= e["rsrp"] <= -40)
            keep("snr", has("snr"))
            keep("rxlev", has("rxlev") and e["rxlev"] != 0)

    def radio(self, key, e):
        c = self.cell(key)
        for f in ("ul_freq", "bandwidth", "ta"):
            if e[f]:
                c["radio"][f] = e[f]
        if e["rrc_state"] is not None and e["rrc_state"] >= 0:
            c["radio"]["rrc_state"] = e["rrc_state"]
        if e["emm_state"] is not None and e["emm_state"] >= 0:
            c["radio"] |= {"emm_state": e["emm_state"], "emm_substate": e["emm_substate"]}
        if key[0] == "LTE":
            c["radio"]["barring_emergency"] = e["barring_emergency"]

    def promote(self, key):
        rat, freq, phy = key
        weak = self.cells.pop((rat, freq, 0), None) if rat == "LTE" and phy else None
        if weak is None:
            return
        c = self.cell(key)
        self.merge(c, {"cid": None, "tac": None, "mcc": weak["plmn"] and weak["plmn"][0], "mnc": weak["plmn"] and weak["plmn"][1], "mnc_digits": weak["digits"], "barred": weak["barred"]})
        c["radio"] |= weak["radio"]
        self.take_over(key, c, weak)

    def take_over(self, key, c, weak):
        if not c["level_known"] and weak["level_known"]:
            c["levels"], c["level_known"] = weak["levels"], True
        c["seen"] += weak["seen"]
        c["ever"] |= weak["ever"]
        if self.serving.get(key[0]) == (*key[:2], 0):
            self.serving[key[0]] = key

    def promote_gsm(self, key):
        weak = self.cells.pop((*key[:2], 0), None) if key[2] else None
        if weak is not None:
            new = key not in self.cells
            c = self.cell(key)
            self.merge(c, {f: weak[f] for f in ("cid", "tac", "barred")} | {"mcc": weak["plmn"] and weak["plmn"][0], "mnc": weak["plmn"] and weak["plmn"][1], "mnc_digits": weak["digits"]})
            if new:
                c["radio"] |= weak["radio"]
            self.take_over(key, c, weak)

    def told(self, e):
        rat, key = e["rat"], (e["rat"], e["nb_freq"], e["nb_phy"] or 0)
        if e["nb_freq"] is None or (rat == "LTE" and not 1 <= (e["nb_phy"] or 0) <= 503):
            return
        self.promote_gsm(key) if rat == "GSM" else self.promote(key)
        c = self.cell(key)
        if rat == "GSM":
            c["seen"] += 1
        if rat == "LTE" and e["nb_freq"] == e["freq"] and e["mcc"] and c["plmn"] is None:
            c["plmn"], c["soft"] = (e["mcc"], e["mnc"]), False
        if e["nb_source"] != "inter" and e[{"LTE": "rsrp", "NR": "rsrp", "GSM": "rxlev", "WCDMA": "rscp"}[rat]]:
            self.level(key, e)
        if e["cgi_cid"]:
            self.merge(c, {f: e[f"cgi_{f}"] for f in ("mcc", "mnc", "tac", "cid")})
            if rat == "LTE":
                self.claim(key, e["cgi_cid"])

    def add(self, e):
        if e["kind"] == "neighbour":
            return self.told(e)
        key = (e["rat"], e["freq"], e["phy"])
        if e["rat"] == "LTE" and e["phy"] == 0 and e["kind"] == "passport":
            homes = [k for k, c in self.cells.items() if k[0] == "LTE" and k[1] == e["freq"] and k[2] and not (e["cid"] and c["cid"] and c["cid"] != e["cid"])]
            if len(homes) == 1:
                key = homes[0]
            elif not e["cid"] and e["mcc"] and len(homes) > 1:
                for k in homes:
                    self.merge(self.cells[k], e)
                    self.cells[k]["seen"] += 1
                self.cells.pop(key, None)
                if self.serving.get("LTE") == key:
                    self.serving.pop("LTE")
                return
            else:
                e = e | {"cid": None, "tac": None}
        self.promote(key)
        c = self.cell(key)
        c["seen"] += 1
        if e["kind"] == "passport":
            self.merge(c, e)
            c["ever"] |= self.serving.get(key[0]) == key and c["cid"] is not None
            if key[0] == "LTE" and key[2]:
                if e["cid"]:
                    self.claim(key, e["cid"])
                if e["mcc"]:
                    self.fan_out(key[1], (e["mcc"], e["mnc"]))
        elif e["kind"] == "serving":
            self.serving[key[0]] = key
            c["ever"] |= c["cid"] is not None
        elif e["kind"] == "signal":
            self.level(key, e)
        elif e["kind"] == "radio":
            self.radio(key, e)


LEVELS, RADIO = ("rsrp", "rsrq", "rssi", "snr", "rscp", "ecio", "rxlev"), ("ul_freq", "bandwidth", "ta", "rrc_state", "emm_state", "emm_substate", "barring_emergency")


def folded(rows):
    f = Fold()
    for e in sorted(rows, key=lambda r: r["seq"]):
        f.add(e)
    return {
        k: (c["seen"], c["cid"], c["tac"], c["plmn"], c["soft"], c["ever"], f.serving.get(k[0]) == k, c["barred"], c["digits"], tuple(c["levels"].get(x) for x in LEVELS), tuple(c["radio"].get(x) for x in RADIO))
        for k, c in f.cells.items()
    }


def in_set_form(df):
    return {
        (r.rat, r.freq, r.phy): (
            r.seen, r.cid, r.tac, None if r.mcc is None else (r.mcc, r.mnc), r.plmn_soft, r.ever_serving, r.is_serving, r.barred, r.mnc_digits, tuple(r[x] for x in LEVELS), tuple(r[x] for x in RADIO),
        )
        for r in df.collect()
    }


def scenario(seed, n=160):
    """Random events of one session: conflicting PLMNs and areas, shared cell ids, weak rows, neighbours of all technologies."""
    rng, out = random.Random(seed), []
    maybe = lambda x, p=0.5: x if rng.random() < p else None
    for i in range(n):
        rat = rng.choice(["LTE"] * 5 + ["WCDMA", "GSM", "NR"])
        freq = rng.choice({"LTE": [375, 1596, 3200], "WCDMA": [10700], "GSM": [40, 41], "NR": [620000]}[rat])
        phy = rng.choice([0, 1, 2, 3, 4]) if rat == "LTE" else rng.randrange(1, 4)
        kind = rng.choice(["passport"] * 4 + ["signal", "radio", "serving", "neighbour"])
        e = dict.fromkeys(NAMES) | {"session_id": 0, "sub_seq": 0, "seq": i + 1, "rat": rat, "kind": kind, "freq": freq, "phy": phy}
        if kind in ("passport", "neighbour"):
            e |= {"mcc": maybe(250, 0.7), "mnc": rng.choice([0, 1, 2])}
        if kind == "passport":
            e |= {"cid": maybe(phy % 3 + 7 if rat == "LTE" else 100 + freq + phy), "tac": maybe(rng.choice([5, 6, 0xFFFF])), "mnc_digits": rng.choice([None, 0, 2, 3]), "barred": rng.choice([True, False])}
            if rat == "LTE" and phy == 0:
                e["cid"] = None
        if kind in ("signal", "neighbour"):
            e |= {"rsrp": maybe(rng.choice([-160.0, -90.0, -80.5])), "rsrq": maybe(rng.choice([-12.0, 3.0])), "rssi": maybe(-60.0), "snr": maybe(4.0), "rscp": maybe(rng.choice([0.0, -70.0])), "ecio": maybe(-3.0), "rxlev": maybe(rng.choice([0.0, -66.0]))}
        if kind == "radio":
            e |= {c: maybe(rng.choice([0, 3, 4])) for c in ("ul_freq", "bandwidth", "ta")} | {"rrc_state": maybe(rng.choice([-1, 0, 2])), "emm_state": maybe(rng.choice([-1, 1, 2])), "emm_substate": maybe(9), "barring_emergency": rng.choice([True, False])}
        if kind == "neighbour":
            inter = rat == "LTE" and rng.random() < 0.5
            e |= {"nb_freq": rng.choice([375, 1596, 3200]) if inter else freq, "nb_phy": rng.randrange(1, 5) if rat != "GSM" else rng.choice([1, 2, None]), "nb_source": "inter" if inter else "meas"}
            if rat == "GSM":
                e["nb_phy"] = e["nb_phy"] or 0
        out.append(e)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_set_form_equals_the_fold(spark, seed):
    rows = scenario(seed)
    df = events(spark, *rows)
    got = in_set_form(R.build_registry(df.repartition(3).orderBy(F.rand(seed))))
    want = folded(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k], k


def test_identity_made_of_parts_stays(spark):
    """A full identity that was put together before the first full event is not replaced; one that was not is."""
    parts = [lte("passport", 375, 1, mcc=250, mnc=1), lte("passport", 375, 1, cid=1111, tac=77), lte("passport", 375, 1, mcc=250, mnc=2, cid=2222, tac=88)]
    late = [lte("passport", 375, 1, mcc=250, mnc=1), lte("passport", 375, 1, cid=1111), lte("passport", 375, 1, mcc=250, mnc=2, cid=1111, tac=77)]
    for rows, want in ((parts, (250, 1, 77, 1111)), (late, (250, 2, 77, 1111))):
        for got in (R.merge_passport(events(spark, *rows)).first(), R.build_registry(events(spark, *rows)).first()):
            assert (got.mcc, got.mnc, got.tac, got.cid) == want


def test_levels_and_parameters(spark):
    df = events(
        spark, lte("signal", 375, 1, rsrp=-90.0, rsrq=-9.0), lte("signal", 375, 1, rsrp=-155.0, rsrq=2.0, rssi=-60.0), dict(rat="NR", kind="signal", freq=7, phy=3, rsrp=-80.0, snr=5.0), dict(rat="NR", kind="signal", freq=7, phy=3, rsrq=-8.0),
        lte("radio", 375, 1, ul_freq=18375, emm_state=2, emm_substate=4, barring_emergency=True), lte("radio", 375, 1, ul_freq=0, emm_state=-1, emm_substate=7, barring_emergency=None),
    )
    levels, radio = cells(R.latest_signal(df)), cells(R.latest_radio(df))
    assert (levels["LTE", 375, 1].rsrp, levels["LTE", 375, 1].rsrq, levels["LTE", 375, 1].rssi) == (-90.0, -9.0, -60.0)
    assert (levels["NR", 7, 3].rsrp, levels["NR", 7, 3].rsrq, levels["NR", 7, 3].snr) == (None, -8.0, None)
    r = radio["LTE", 375, 1]
    assert (r.ul_freq, r.emm_state, r.emm_substate, r.barring_emergency) == (18375, 2, 4, None)


def test_times_go_by_order(spark):
    """Ticks of zero are none; wall time goes before ticks."""
    df = events(spark, lte("radio", 375, 1, ts_ticks=0), lte("radio", 375, 1, ts_ticks=40), lte("radio", 375, 1, ts_ticks=50), dict(rat="GSM", kind="neighbour", freq=40, phy=1, nb_freq=41, nb_phy=9, ts_ticks=7))
    r = cells(R.seen_stats(df))
    assert (r["LTE", 375, 1].seen, r["LTE", 375, 1].first_seen, r["LTE", 375, 1].first_tick, r["LTE", 375, 1].last_tick) == (3, None, 40, 50)
    assert r["GSM", 41, 9].seen == 1


def test_serving_without_its_id_is_no_camp(spark):
    """A cell that served only while another one owned its cell id never served as that cell."""
    rows = [lte("passport", 375, 1, mcc=250, mnc=1, tac=5, cid=9), lte("passport", 375, 2, mcc=250, mnc=1, tac=5, cid=9), lte("serving", 375, 1), lte("serving", 375, 2), lte("passport", 375, 1, mcc=250, mnc=1, tac=5, cid=9)]
    got = cells(R.build_registry(events(spark, *rows)))
    assert (got["LTE", 375, 1].ever_serving, got["LTE", 375, 2].ever_serving) == (False, True)
    assert (got["LTE", 375, 1].cid, got["LTE", 375, 2].cid) == (9, None)


def test_events_without_a_key(spark):
    """The packet's radio key first, then the cell that served before the packet; signals without either are dropped."""
    rows = [
        dict(kind="signal", seq=1, rsrp=-70.0), dict(kind="serving", seq=2, freq=375, phy=1), dict(kind="radio", seq=3, sub_seq=0, freq=1596, phy=2), dict(kind="signal", seq=3, sub_seq=1, rsrp=-91.0),
        dict(kind="serving", seq=4, sub_seq=0, freq=375, phy=5), dict(kind="signal", seq=4, sub_seq=1, rsrp=-92.0, rat="LTE"), dict(kind="radio", seq=5, rrc_state=3),
    ]
    got = cells(R.build_registry(events(spark, *rows)))
    assert set(got) == {("LTE", 375, 1), ("LTE", 375, 5), ("LTE", 1596, 2)}
    assert (got["LTE", 1596, 2].rsrp, got["LTE", 375, 1].rsrp, got["LTE", 375, 5].rrc_state) == (-91.0, -92.0, 3)


def gsm(kind, freq=None, phy=None, **more):
    return dict(rat="GSM", kind=kind, freq=freq, phy=phy, **more)


def test_gsm_passports_find_their_cell(spark):
    id_ = dict(mcc=250, mnc=1, tac=5)
    bound = lambda *rows, hints=None: {k[1:]: v.cid for k, v in cells(R.build_registry(events(spark, *rows), hints)).items()}
    assert bound(gsm("passport", 40, 1, cid=7, **id_), gsm("serving", 41, 2), gsm("passport", cid=7, **id_)) == {(40, 1): 7, (41, 2): None}
    assert bound(gsm("serving", 41, 2), gsm("passport", cid=7, **id_)) == {(41, 2): 7}
    assert bound(gsm("serving", 41, 2), gsm("passport", 41, 2, cid=8, **id_), gsm("passport", cid=7, **id_)) == {(41, 2): 8, (0, 7): 7}
    assert bound(gsm("serving", 41, 2), gsm("passport", 41, 2, cid=8, **id_), gsm("passport", cid=7, **id_), gsm("passport", 40, 3, cid=7, **id_)) == {(41, 2): 8, (40, 3): 7}
    hints = spark.createDataFrame([(0, 4, 77)], "session_id long, seq long, freq int")
    rows = [gsm("serving", 41, 2), gsm("passport", 41, 2, cid=8, **id_), gsm("radio", 77, 6), gsm("passport", seq=5, cid=7, **id_), gsm("passport", seq=6, cid=9, **id_)]
    assert bound(*rows, hints=hints) == {(41, 2): 8, (77, 6): 7, (0, 9): 9}
    assert bound(gsm("passport", 40, 0, cid=7, **id_), gsm("neighbour", 41, 2, nb_freq=40, nb_phy=33)) == {(40, 33): 7}
    assert bound(gsm("passport", **id_)) == {}


def test_weak_passports_choose_among_rows(spark):
    """Rows that hold another cell id are not counted; a waiting signal gives way to one the cell has."""
    full = dict(mcc=250, mnc=1, tac=5)
    got = cells(R.build_registry(events(spark, lte("passport", 375, 1, cid=9, **full), lte("radio", 375, 2), lte("passport", 375, 0, cid=8, **full))))
    assert (got["LTE", 375, 1].cid, got["LTE", 375, 2].cid) == (9, 8)
    got = cells(R.build_registry(events(spark, lte("signal", 375, 1, rsrp=-70.0), lte("signal", 375, 0, rsrp=-90.0, rsrq=-5.0), lte("radio", 375, 1))))
    assert (got["LTE", 375, 1].rsrp, got["LTE", 375, 1].rsrq, got["LTE", 375, 1].seen) == (-70.0, None, 3)
    got = cells(R.build_registry(events(spark, lte("radio", 375, 1), lte("signal", 375, 0, rsrp=-90.0), lte("radio", 375, 1))))
    assert got["LTE", 375, 1].rsrp == -90.0
    got = cells(R.build_registry(events(spark, lte("radio", 375, 1), lte("radio", 375, 2), lte("signal", 375, 0, rsrp=-90.0), lte("passport", 375, 0, mcc=250, mnc=1), lte("radio", 375, 1))))
    assert got["LTE", 375, 1].rsrp is None and got["LTE", 375, 2].mcc == 250


def test_neighbour_lists(spark):
    df = events(
        spark, lte("neighbour", 375, 1, nb_freq=375, nb_phy=2, nb_source="meas", rsrp=-90.0, nb_offset=3), lte("neighbour", 375, 1, nb_freq=375, nb_phy=2, nb_source="meas", rsrq=-9.0, nb_offset=0),
        lte("neighbour", 375, 1, nb_freq=1596, nb_phy=4, nb_source="inter", nb_thresh_high=6), lte("neighbour", 375, 1, nb_freq=1596, nb_phy=3, nb_source="inter", nb_thresh_high=0),
        gsm("neighbour", 40, 1, seq=10, nb_freq=50, nb_phy=1), gsm("neighbour", 40, 1, seq=10, nb_freq=51, nb_phy=2), gsm("neighbour", 40, 1, seq=11, nb_freq=52, nb_phy=3),
        lte("neighbour", 375, 1, nb_freq=375, nb_phy=7, nb_source="meas", rsrp=-80.0, cgi_mcc=250, cgi_mnc=1, cgi_tac=4, cgi_cid=12),
    )
    lists = {(r.freq, r.phy, r.nb_freq): r for r in R.merge_neighbour_lists(df).collect()}
    assert (lists[375, 1, 1596].pcis, lists[375, 1, 1596].nb_thresh_high, lists[375, 1, 1596].reports) == ([3, 4], 6, 2)
    measured = {r.nb_phy: r for r in R.merge_measured(df).collect()}
    assert (measured[2].rsrp, measured[2].rsrq, measured[2].nb_offset, measured[2].reports) == (-90.0, -9.0, 3, 2)
    assert [[tuple(n) for n in r.neighbours] for r in R.latest_lists(df).collect()] == [[(52, 3)]]
    got = cells(R.build_registry(df))
    assert (got["LTE", 375, 7].cid, got["LTE", 375, 7].rsrp, got["LTE", 375, 7].seen, got["LTE", 1596, 4].mcc) == (12, -80.0, 0, None)

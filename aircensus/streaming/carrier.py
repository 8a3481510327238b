"""K1 with all rules of a carrier: weak rows, fan-out and ordered identity as arbitrary state.

State belongs to (session_id, rat, freq), so a session spreads over tasks.  It
holds the carrier's cells and the events that wait for the watermark: a timer
applies them in their order, so shuffled arrival inside the delay changes
nothing, and what comes later than that is dropped.  The rules are the batch's
(R2-R6, R8, R11): which values count is computed by the tables of ``merge``
before the state sees an event.

Cell ids are owned across carriers (R9): each row tells when its cell claimed
its id, and ``with_claims`` takes it from all but the last.  Passports and events
without a key (R7, C11) have to be bound before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import merge as M
from ..operators import registry as R

_CELL = "seen long, mcc int, mnc int, soft boolean, tac int, cid long, claimed long, heard boolean, fields map<string,double>"
_EVENT = "ms long, phy int, kind string, mcc int, mnc int, tac int, cid long, values map<string,double>"
_OUT = "session_id long, rat string, freq int, phy int, at long, gone boolean, seen long, mcc int, mnc int, plmn_soft boolean, tac int, cid long, claimed long, fields map<string,double>"
#: Kinds of events that are no sighting of a cell.
_TOLD = ("told", "heard", "named")


def _counting(columns: list[str]) -> Column:
    """The values of an event that count, by the tables of the batch; a value that is replaced by nothing is null."""
    items = []
    for rules, kinds in ((M.SIGNAL, ("signal", "heard")), (M.RADIO, ("radio", "registration"))):
        for r in M.present(rules, columns):
            ok = F.col("kind").isin(*kinds) & F.expr(r.counts) & (F.col("rat").isin(*r.rats) if r.rats else F.lit(True))
            items += [F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(f).alias("k"), F.col(f).cast("double").alias("v"))) for f in r.fields]
    held = F.array_compact(F.array(*items))
    return F.map_from_entries(F.transform(F.array_distinct(F.transform(held, lambda x: x["k"])), lambda k: F.struct(k, F.get(F.filter(held, lambda x: x["k"] == k), 0)["v"])))


def _valid(x: int | None, most: int) -> bool:
    return x is not None and 1 <= x <= most


class Carrier(StatefulProcessor):
    """The cells of one carrier of a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "phy int", _CELL)
        self.waiting = handle.getMapState("waiting", "at long", _EVENT)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        done, times = timerValues.getCurrentWatermarkInMs(), set()
        for r in rows:
            if r.ms > done:
                self.waiting.updateValue((r.at,), (r.ms, r.phy, r.kind, r.mcc, r.mnc, r.tac, r.cid, dict(r["values"] or ())))
                times.add(r.ms)
        for ms in times:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(((k[0], v) for k, v in self.waiting.iterator() if v[0] <= now), key=lambda x: x[0])
        cells = {k[0]: dict(zip(_NAMES, v)) | {"fields": dict(v[-1] or {})} for k, v in self.cells.iterator()} if due else {}
        changed: set[int] = set()
        for at, event in due:
            self.waiting.removeKey((at,))
            changed |= _apply(cells, key[1], at, dict(zip(_EVENT_NAMES, event)))
        for phy in sorted(changed):
            c = cells.get(phy)
            if c is None:
                if self.cells.containsKey((phy,)):
                    self.cells.removeKey((phy,))
                yield _ROW(*key, phy, due[-1][0], True, *[None] * 7, [])
            else:
                self.cells.updateValue((phy,), tuple(c[n] for n in _NAMES))
                yield _ROW(*key, phy, due[-1][0], False, *(c[n] for n in _NAMES[:-2]), list(c["fields"].items()))

    def close(self) -> None:
        pass


_NAMES = [c.split()[0] for c in _CELL.split(", ")]
_ROW = Row(*(c.split()[0] for c in _OUT.split(", ")))
_EVENT_NAMES = [c.split()[0] for c in _EVENT.split(", ")]


def _merge(c: dict, e: dict) -> None:
    """R3 for one passport."""
    plmn, eci, area = bool(e["mcc"]), _valid(e["cid"], 0x0FFFFFFF), _valid(e["tac"], 0xFFFE)
    win = plmn and eci and area and not (c["cid"] and c["tac"] and c["mcc"])
    if eci and (win or not c["cid"]):
        c["cid"] = e["cid"]
    if area and (win or not c["tac"]):
        c["tac"] = e["tac"]
    if plmn and (win or not c["mcc"] or c["soft"]):
        c["mcc"], c["mnc"], c["soft"] = e["mcc"], e["mnc"], False


def _apply(cells: dict[int, dict], rat: str, at: int, e: dict) -> set[int]:
    """Applies one event; the codes whose cells changed or went."""
    phy, kind, lte = e["phy"], e["kind"], rat == "LTE"
    changed = set()
    if lte and phy == 0 and kind == "passport":  # R6
        homes = [p for p, c in cells.items() if p and not (e["cid"] and c["cid"] and c["cid"] != e["cid"])]
        if len(homes) == 1:
            phy = homes[0]
        elif homes and not e["cid"] and e["mcc"]:
            for p in homes:
                _merge(cells[p], e)
                cells[p]["seen"] += 1
            cells.pop(0, None)
            return {0, *homes}
        else:
            e = e | {"cid": None, "tac": None}
    new = {"seen": 0, "mcc": None, "mnc": None, "soft": False, "tac": None, "cid": None, "claimed": None, "heard": False}
    c = cells.setdefault(phy, new | {"fields": {}})
    if lte and phy and (weak := cells.pop(0, None)):
        changed.add(0)
        _merge(c, {"mcc": weak["mcc"], "mnc": weak["mnc"], "cid": None, "tac": None})
        levels = set(M.fields(M.SIGNAL))
        c["fields"] |= {k: v for k, v in weak["fields"].items() if k not in levels or not c["heard"]}
        c["heard"] |= weak["heard"]
        c["seen"] += weak["seen"]
    changed.add(phy)
    c["seen"] += kind not in _TOLD or (rat == "GSM" and kind == "told")
    c["fields"] |= e["values"] or {}
    c["heard"] |= kind in ("signal", "heard")
    if kind == "told" and e["mcc"] and not c["mcc"]:
        c["mcc"], c["mnc"], c["soft"] = e["mcc"], e["mnc"], False
    if kind in ("passport", "named"):
        _merge(c, e)
        if lte and phy and e["cid"]:
            c["claimed"] = at
        if lte and phy and e["mcc"] and kind == "passport":  # R8
            for p, other in cells.items():
                if p and not other["mcc"]:
                    other["mcc"], other["mnc"], other["soft"] = e["mcc"], e["mnc"], True
                    changed.add(p)
    return changed


def stream_carriers(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """K1: changed cells of each carrier as its events pass the watermark; ``gone`` rows were taken over by another.

    Needs the RocksDB state store.  ``wall_time`` must rise with ``seq`` in a session.
    """
    rows = R.expand_neighbours(R.with_at(events.withWatermark("wall_time", delay))).filter("kind not in ('neighbour', 'serving') and freq is not null and phy is not null")
    narrow = rows.select("session_id", "rat", "freq", "at", "wall_time", F.unix_millis("wall_time").alias("ms"), "phy", "kind", "mcc", "mnc", "tac", "cid", _counting(rows.columns).alias("values"))
    state = narrow.groupBy("session_id", "rat", "freq")
    return state.transformWithState(statefulProcessor=Carrier(), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")


def latest_cells(changes: DataFrame) -> DataFrame:
    """The cells that a stream's output leaves: of each the last change, without those that went."""
    last = changes.withColumn("_r", F.row_number().over(W.partitionBy(*R.KEY).orderBy(F.desc("at")))).filter("_r = 1 and not gone")
    return last.drop("_r", "gone")


def with_claims(cells: DataFrame) -> DataFrame:
    """R9 over the latest cells: of those that hold one LTE cell id the last to claim it keeps id and area."""
    claimed = F.coalesce((F.col("rat") == "LTE") & (F.col("phy") != 0) & F.col("cid").isNotNull(), F.lit(False))
    held = cells.filter(claimed).withColumn("_lost", F.col("claimed") < F.max("claimed").over(W.partitionBy("session_id", "cid")))
    kept = held.withColumns({c: F.when(~F.col("_lost"), F.col(c)) for c in ("cid", "tac")}).select(*cells.columns)
    return cells.filter(~claimed).unionByName(kept)

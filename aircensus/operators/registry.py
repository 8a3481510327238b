"""Registry of cells as aggregations and windows over ordered events.

Events: session_id, seq, rat, freq, phy, kind, mcc, mnc, cid, tac, wall_time and
whatever fields of ``merge`` a source has; neighbours come as kind ``neighbour``
with nb_freq, nb_phy, nb_source.  ``seq`` orders the packets of a session and
``sub_seq``, where it exists, the events of a packet.  A registry has one row per
(session_id, rat, freq, phy).

Contract: the set form below equals the ordered fold over the events where a cell
claims one cell id (another one can still own it first, and lose it).  Windows
are partitioned by session and carrier or cell, never by nothing; what depends on
one cell's events alone is merged by one aggregation, which combines before the
shuffle.  Null keys make rows of their own and match nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import merge as M
from .durable import compiled_rows, durable

KEY = ["session_id", "rat", "freq", "phy"]
CARRIER = ["session_id", "freq"]
#: Places that an event leaves for what follows from it; packets are ``STEP * SUBS`` apart.
STEP, SUBS = 8, 4096


def _no(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c) == 0, F.lit(True))


def with_at(events: DataFrame) -> DataFrame:
    """Adds ``at``, one number that orders the events of a session, and ``waited``: did the event wait for its cell?"""
    if "waited" not in events.columns:
        events = events.withColumn("waited", F.lit(False))
    if "at" in events.columns:
        return events
    sub = F.coalesce("sub_seq", F.lit(0)) if "sub_seq" in events.columns else F.lit(0)
    return events.withColumn("at", (F.col("seq") * SUBS + sub).cast("long") * STEP)


def _before(*by: str):
    return W.partitionBy(*by).orderBy("at").rowsBetween(W.unboundedPreceding, -1)


def _next(value: Column, *by: str) -> Column:
    """The first value that is not null after each row: a running last against the order, which costs no more per row than one."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, -1))


def asof_serving(events: DataFrame) -> DataFrame:
    """Adds serving_freq, serving_phy: the serving cell of the same technology just before each event.

    Only serving events feed the window's value; the frame is evaluated as a running last.
    """
    key = F.when(F.col("kind") == "serving", F.struct("freq", "phy"))
    held = with_at(events).withColumn("_s", F.last(key, ignorenulls=True).over(_before("session_id", "rat")))
    return held.withColumns({"serving_freq": F.col("_s.freq"), "serving_phy": F.col("_s.phy")}).select(*events.columns, "serving_freq", "serving_phy")


def bind_serving(events: DataFrame) -> DataFrame:
    """Events without a key.

    An event takes the last LTE radio key of its packet (``sub_seq`` order); else,
    unless it is a passport, the cell that served before the packet, else the one
    that serves by now.  Without one it is dropped, but for neighbours, which
    then have no teller.  Events with a key stay out of the serving window.
    """
    rows = with_at(events)
    bare = _zero("freq") & _zero("phy")
    if "sub_seq" in rows.columns:
        packet = W.partitionBy("session_id", "seq").orderBy("sub_seq").rowsBetween(W.unboundedPreceding, -1)
        key = F.when((F.col("kind") == "radio") & (F.col("rat") == "LTE") & ~_zero("freq"), F.struct("freq", "phy"))
        sticky = F.last(key, ignorenulls=True).over(packet)
        inner = bare & F.col("_k").isNotNull() & (F.col("rat") == "LTE")
        rows = rows.withColumn("_k", sticky).withColumns({c: F.when(inner, F.col(f"_k.{c}")).otherwise(F.col(c)) for c in ("freq", "phy")}).drop("_k")
        # Events of packets are decoded here, once, whatever reads them later.
        compiled_rows(rows.sparkSession)
        rows = durable(rows, "keyed-events")
    open_ = bare & (F.col("kind") != "passport")
    if rows.filter(open_).isEmpty():
        return rows
    serves = F.when((F.col("kind") == "serving") & ~bare, F.struct("freq", "phy"))
    same = W.partitionBy("session_id", "rat")
    earlier = F.last(serves, ignorenulls=True).over(same.orderBy("seq").rangeBetween(W.unboundedPreceding, -1))
    now = F.last(serves, ignorenulls=True).over(_before("session_id", "rat"))
    served = rows.filter(open_ | (F.col("kind") == "serving")).withColumn("_s", F.coalesce(earlier, now)).filter(open_)
    bound = served.filter(F.col("_s").isNotNull() | (F.col("kind") == "neighbour")).withColumns({c: F.col(f"_s.{c}") for c in ("freq", "phy")})
    return rows.filter(~open_).unionByName(durable(bound.select(*rows.columns), "served-events"))


def seen_stats(events: DataFrame) -> DataFrame:
    """R2: how often and when each cell was seen.

    Neighbour reports do not count, but those of GSM count for the cell they
    name.  The first and the last time are those of the events in their order; a
    wall time goes before ticks, and ticks of zero are none.
    """
    rows = with_at(events)
    gsm = rows.filter("kind = 'neighbour' and rat = 'GSM' and nb_freq is not null").withColumns({"freq": F.col("nb_freq"), "phy": F.coalesce("nb_phy", F.lit(0))}) if "nb_freq" in rows.columns else rows.limit(0)
    return rows.filter("kind <> 'neighbour'").unionByName(gsm).groupBy(*KEY).agg(F.count("*").alias("seen"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), *_times(rows.columns, F.lit(True)))


def _times(columns: list[str], among: Column) -> list[Column]:
    at, ticks = F.col("at"), "ts_ticks" in columns
    dated = F.col("wall_time").isNotNull()
    some = (dated | (F.coalesce("ts_ticks", F.lit(0)) != 0)) if ticks else dated
    out = [F.min_by("wall_time", F.when(among & some, at)).alias("first_seen"), F.max_by("wall_time", F.when(among & some, at)).alias("last_seen")]
    if ticks:
        tick = F.when(~dated, F.col("ts_ticks"))
        out += [F.min_by(tick, F.when(among & some, at)).alias("first_tick"), F.max_by(tick, F.when(among & some, at)).alias("last_tick")]
    return out


def merge_passport(events: DataFrame) -> DataFrame:
    """Identity of each cell from its own passports, in one aggregation; see ``merge.identity``."""
    rows = with_at(events).filter("kind = 'passport'")
    return rows.groupBy(*KEY).agg(*M.identity_fields(F.lit(True)), *M.last_fields(M.PASSPORT, F.lit(True), rows.columns)).select(*KEY, *(c.alias(n) for n, c in M.identity().items()), *M.fields(M.present(M.PASSPORT, rows.columns)))


def latest_signal(events: DataFrame) -> DataFrame:
    """Each cell's levels by the rules of ``merge.SIGNAL``."""
    rows = with_at(events).filter("kind = 'signal'")
    return rows.groupBy(*KEY).agg(*M.last_fields(M.SIGNAL, F.lit(True), rows.columns))


def latest_radio(events: DataFrame) -> DataFrame:
    """Each cell's radio parameters by the rules of ``merge.RADIO``; band and duplex follow from the channel."""
    rows = with_at(events).filter("kind = 'radio'")
    return rows.groupBy(*KEY).agg(F.max("seq").alias("radio_seq"), *M.last_fields(M.RADIO, F.lit(True), rows.columns))


def neighbour_rows(events: DataFrame) -> DataFrame:
    """The cells that neighbour reports name.

    A report on the teller's carrier hands on its PLMN; one of a foreign carrier
    does not.  LTE codes are 1..503, NR codes up to 1007, GSM channels 1..1023
    (without a code: 0), WCDMA channels not 0.
    """
    same = (F.col("nb_freq") == F.col("freq")) & (F.col("rat") == "LTE")
    return events.filter(_legal()).select(
        "session_id", "seq", "rat", F.col("nb_freq").alias("freq"), F.coalesce("nb_phy", F.lit(0)).alias("phy"),
        F.when(same, F.col("mcc")).alias("nb_mcc"), F.when(same, F.col("mnc")).alias("nb_mnc"), F.col("phy").alias("from_phy"),
    )


def _legal() -> Column:
    """Is the event a report of a neighbour that has a key?"""
    code = F.col("nb_phy")
    key = (
        F.when(F.col("rat") == "LTE", code.between(1, 503)).when(F.col("rat") == "NR", code.between(0, 1007))
        .when(F.col("rat") == "GSM", F.col("nb_freq").between(1, 1023)).otherwise((F.col("nb_freq") != 0) & code.isNotNull())
    )
    return (F.col("kind") == "neighbour") & F.col("nb_freq").isNotNull() & key


def teller_plmn(events: DataFrame) -> DataFrame:
    """LTE reports of a cell's own carrier that say no PLMN take the first one that the cell had said by then."""
    rows = with_at(events)
    if "nb_freq" not in rows.columns:
        return rows
    open_ = _no((F.col("kind") == "neighbour") & (F.col("rat") == "LTE") & (F.col("nb_freq") == F.col("freq")) & F.col("mcc").isNull())
    asked = rows.filter(open_)
    if asked.isEmpty():
        return rows
    said = rows.filter((F.col("kind") == "passport") & (F.col("rat") == "LTE") & M.has_plmn()).select(*KEY, "at", F.struct("mcc", "mnc").alias("_p"))
    stream = said.unionByName(asked.select(*KEY, "at"), allowMissingColumns=True)
    known = stream.withColumn("_q", F.first("_p", ignorenulls=True).over(_before(*KEY))).filter("_p is null").select("session_id", "rat", "at", "_q").distinct()
    found = asked.join(known, ["session_id", "rat", "at"], "left").withColumns({"mcc": F.col("_q.mcc"), "mnc": F.col("_q.mnc")})
    return rows.filter(~open_).unionByName(found.select(*rows.columns))


def expand_neighbours(events: DataFrame) -> DataFrame:
    """Adds the events that neighbour reports mean for the cells they name.

    ``told`` makes the row and fills a missing PLMN; a measured report is a
    ``heard`` signal, one with a global identity a ``named`` passport.  None of
    them counts as a sighting, except in GSM.  One pass, no shuffle.
    """
    rows = with_at(events)
    if "nb_freq" not in rows.columns:
        return rows
    level = {"LTE": "rsrp", "NR": "rsrp", "GSM": "rxlev", "WCDMA": "rscp"}
    measured = reduce(lambda a, b: a | b, ((F.col("rat") == r) & F.coalesce(F.col(c) != 0, F.lit(False)) for r, c in level.items() if c in rows.columns), F.lit(False))
    heard = F.when(measured & _no((F.col("rat") != "LTE") | (F.col("nb_source") == "meas")), "heard")
    cgi = F.when(F.col("cgi_cid") != 0, "named") if "cgi_cid" in rows.columns else F.lit(None).cast("string")
    kinds = F.array_compact(F.array("kind", F.lit("told"), heard, cgi))
    out = rows.withColumn("_k", F.explode(F.when(_no(_legal()), kinds).otherwise(F.array("kind"))))
    child, named, told = F.col("_k") != F.col("kind"), F.col("_k") == "named", F.col("_k") == "told"
    same = (F.col("nb_freq") == F.col("freq")) & (F.col("rat") == "LTE")
    own = lambda c: F.when(~child, F.col(c))
    fields = {c: F.when(told & same, F.col(c)).otherwise(own(c)) if c in ("mcc", "mnc") else own(c) for c in M.IDENTITY}
    if "cgi_cid" in rows.columns:
        fields = {c: F.when(named, F.col(f"cgi_{c}")).otherwise(x) for c, x in fields.items()}
    unset = {c: F.when(~child | (F.col("_k") == "heard"), F.col(c)) for c in M.fields(M.present((*M.SIGNAL, *M.RADIO, *M.PASSPORT), rows.columns))}
    flags = {c: own(c) for c in M.FLAGS if c in rows.columns}
    place = F.when(told, 1).when(F.col("_k") == "heard", 2).when(named, 3).otherwise(0)
    key = {"freq": F.when(child, F.col("nb_freq")).otherwise(F.col("freq")), "phy": F.when(child, F.coalesce("nb_phy", F.lit(0))).otherwise(F.col("phy"))}
    moved = out.withColumns(unset | flags | fields | key | {"at": F.col("at") + F.when(child, place).otherwise(0)})
    return moved.withColumn("kind", F.col("_k")).select(*rows.columns)


def merge_neighbour_lists(events: DataFrame) -> DataFrame:
    """What each LTE cell tells of each carrier: its codes, how often, and the carrier's last thresholds."""
    rows = with_at(events)
    told = rows.filter("kind = 'neighbour' and rat = 'LTE' and phy <> 0 and nb_phy between 1 and 503")
    return told.groupBy(*KEY, "nb_freq").agg(
        F.array_sort(F.collect_set("nb_phy")).alias("pcis"), F.count("*").alias("reports"), F.max_by("nb_source", "at").alias("source"),
        *M.last_fields(M.CARRIER, F.lit(True), rows.columns),
    )


def told_neighbours(events: DataFrame) -> DataFrame:
    """Each neighbour that a cell names, once: the first source in the order of ``merge.SOURCES``, and what it measured last.

    A carrier or channel told without a code has a null nb_phy.  Measured levels
    (m_*) are those of the source that measures; c_* is a reported identity.
    """
    rows = with_at(events).filter("kind = 'neighbour' and nb_freq is not null")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, M.SOURCES)), F.col("nb_source")), F.lit(99))
    levels = [c for c in ("rsrp", "rsrq", "snr", "rssi") if c in rows.columns]
    measured = [F.max_by(c, F.when((F.col("nb_source") == "meas") & F.col(c).isNotNull(), F.col("at"))).alias(f"m_{c}") for c in levels]
    if "rscp" in rows.columns:
        measured.append(F.max_by("rscp", F.when((F.col("nb_source") == "wcdma") & (F.col("rscp") != 0), F.col("at"))).alias("m_rscp"))
    if "cgi_cid" in rows.columns:
        measured += [F.min_by(f"cgi_{c}", F.when(F.col("cgi_cid") != 0, F.col("at"))).alias(f"c_{c}") for c in M.IDENTITY]
    return rows.groupBy(*KEY, "nb_freq", "nb_phy").agg(F.min_by("nb_source", rank).alias("source"), F.count("*").alias("reports"), *measured)


def merge_measured(events: DataFrame) -> DataFrame:
    """What each LTE or NR cell measures of each neighbour on its own carrier: the last of each level, the last offset that is not zero."""
    rows = with_at(events)
    told = rows.filter("kind = 'neighbour' and rat in ('LTE', 'NR') and nb_freq = freq and nb_phy <= if(rat = 'LTE', 503, 1007)")
    return told.groupBy(*KEY, "nb_phy").agg(F.count("*").alias("reports"), *M.last_fields(M.MEASURED, F.lit(True), rows.columns))


def latest_lists(events: DataFrame) -> DataFrame:
    """The GSM and WCDMA neighbours of each cell: those of the last packet that named any, as a whole."""
    told = events.filter("kind = 'neighbour' and rat in ('GSM', 'WCDMA') and nb_freq is not null")
    packets = told.groupBy(*KEY, "seq").agg(F.array_sort(F.collect_set(F.struct("nb_freq", "nb_phy"))).alias("neighbours"))
    return packets.groupBy(*KEY).agg(F.max_by("neighbours", "seq").alias("neighbours"), F.max("seq").alias("told_seq"))


def promote_weak(events: DataFrame) -> DataFrame:
    """LTE events without a PCI (phy 0) move to a PCI of their carrier.

    A passport stays whole if there is just one row it can belong to: rows seen so
    far on the carrier that hold no other cell id.  Otherwise it loses cell id and
    area.  A PLMN alone goes to all rows, if there are several, and ends what
    waited.  Everything else waits for the next PCI of the carrier; without one
    the weak row stays.  A waiting signal is heard only if its cell has none yet.
    """
    rows = with_at(events)
    lte = (F.col("rat") == "LTE") & ~_zero("freq") & (F.col("kind") != "neighbour")
    strong, passport = ~_zero("phy"), F.col("kind") == "passport"
    waiting = rows.filter(lte & _zero("phy"))
    # Decisions need keys and places of the carriers that have weak rows, and nothing else.
    carriers = waiting.select(*CARRIER).distinct()
    marked = rows.filter(lte).select(*CARRIER, "phy", "at", "kind", "cid", "mcc").join(carriers, CARRIER, "left_semi")
    first = F.row_number().over(W.partitionBy(*CARRIER, "phy").orderBy("at")) == 1
    marked = marked.withColumn("_new", F.when(strong & first, 1).otherwise(0))
    past = _before(*CARRIER)
    seen = marked.withColumns({"_pcis": F.coalesce(F.sum("_new").over(past), F.lit(0)), "_only": F.max(F.when(strong, F.col("phy"))).over(past)})
    spread = ~strong & passport & _zero("cid") & M.has_plmn() & (F.col("_pcis") > 1)
    turn = F.when(strong, F.struct("phy", "at")).when(spread, F.struct(F.lit(-1).cast("int").alias("phy"), "at"))
    seen = durable(seen.withColumns({"_spread": spread, "_next": _next(turn, *CARRIER)}).filter(~strong), "weak-turns")

    # Rows of a carrier are at most 503, so passports meet few of them.
    there = rows.filter(lte & strong).join(carriers, CARRIER, "left_semi").groupBy(*CARRIER, F.col("phy").alias("_phy"))
    own = F.col("kind").isin("signal", "heard")
    places = durable(there.agg(F.min("at").alias("_first"), *(x.alias(n) for x, n in zip(_first_id(), ("_id", "_id_at"))), F.min(F.when(own, F.col("at"))).alias("_own")), "weak-places")
    asking = seen.filter(passport & ~_zero("cid") & (F.col("_pcis") > 0)).select(*CARRIER, "at", "cid")
    other = _no((F.col("_id_at") < F.col("at")) & (F.col("_id") != F.col("cid")))
    homes = asking.join(places, CARRIER).filter((F.col("_first") < F.col("at")) & ~other).groupBy(*CARRIER, "at").agg(F.count("*").alias("_homes"), F.min("_phy").alias("_home"))

    alone = passport & F.when(_zero("cid"), F.col("_pcis") == 1).otherwise(_no(F.col("_homes") == 1))
    home = F.when(_zero("cid"), F.col("_only")).otherwise(F.col("_home"))
    decided = seen.join(homes, [*CARRIER, "at"], "left").select(
        *CARRIER, "at", "_spread", (passport & ~alone).alias("_bare"), (~alone & _no(F.col("_next.phy") == -1)).alias("_ended"),
        F.when(~alone, F.col("_next.at")).alias("_waits"), F.when(alone, home).otherwise(F.coalesce("_next.phy", F.lit(0))).alias("_to"),
    )
    known = waiting.join(decided, [*CARRIER, "at"])
    # What a PLMN for all ends is forgotten, but for the fact that another cell served no more.
    gone = F.col("_ended") & (F.col("kind") == "serving")
    moved = known.filter(~F.col("_spread") & (~F.col("_ended") | gone)).withColumns({c: F.when(~F.col("_bare"), F.col(c)) for c in ("cid", "tac")})
    moved = moved.withColumns({"kind": F.when(gone, "gone").otherwise(F.col("kind")), "waited": F.col("_waits").isNotNull()})
    heard = _hushed(moved, places.select(*CARRIER, F.col("_phy").alias("_to"), "_own")).withColumn("phy", F.col("_to"))
    copies = known.filter("_spread").join(places, CARRIER).filter(F.col("_first") < F.col("at")).withColumn("phy", F.col("_phy"))
    resolved = durable(heard.select(*rows.columns).unionByName(copies.select(*rows.columns)), "weak-resolved")
    return rows.filter(~_no(lte & _zero("phy"))).unionByName(resolved)


def _hushed(moved: DataFrame, own: DataFrame) -> DataFrame:
    """Signals that waited become silent if their cell (_to) had one of its own before (_own), or took one over earlier."""
    signal = F.col("kind") == "signal"
    batch = F.min(F.when(signal, F.col("_waits"))).over(W.partitionBy(*CARRIER, "_to"))
    met = moved.withColumn("_batch", batch).join(own, [*CARRIER, "_to"], "left")
    deaf = signal & (_no(F.col("_own") < F.col("_waits")) | _no(F.col("_batch") < F.col("_waits")))
    return met.withColumn("kind", F.when(deaf, "silent").otherwise(F.col("kind")))


def _first_id() -> tuple[Column, Column]:
    """(first valid cell id, its place) as aggregates."""
    held = F.when(F.col("kind").isin("passport", "named") & M.has_cid(), F.col("at"))
    return F.min_by("cid", held), F.min(held)


def bind_gsm(events: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Passports without a channel.

    Without a cell id they go to the serving cell.  With one they go to a cell that
    has it, else to the serving cell if that has none or the same, else to the
    channel of the last unused hint (GSM; its lowest code, 0 if it has none), else
    they wait under {0, cid} until a cell claims the id (GSM) or are dropped.
    ``hints``: session_id, seq, freq.
    """
    rows = with_at(events)
    columns = rows.columns
    loose = (F.col("kind") == "passport") & _zero("freq")
    placed = rows.filter((F.col("kind") == "passport") & ~_zero("freq") & ~_zero("cid"))
    asked = rows.filter(loose)
    if asked.isEmpty():
        return rows
    name = ["session_id", "rat", "cid"]
    key = F.struct("freq", "phy", "at")
    both = placed.select(*name, "at", key.alias("_k")).unionByName(asked.filter(~_zero("cid")).select(*name, "at", F.lit(None).cast(placed.select(key.alias("k")).schema["k"].dataType).alias("_k")))
    homes = both.withColumns({"_home": F.min("_k").over(_before(*name)), "_later": _next(F.col("_k"), *name)}).filter("_k is null")
    homes = homes.withColumn("_left", F.row_number().over(W.partitionBy(*name, "_later").orderBy(F.desc("at")))).select(*name[:2], "at", "_home", "_later", "_left")
    serving = rows.filter((F.col("kind") == "serving") & ~_zero("freq"))
    served = asof_serving(serving.select(*KEY, "at", "kind").unionByName(asked.select(*KEY, "at", "kind"))).filter("kind = 'passport'")
    out = asked.join(homes, ["session_id", "rat", "at"], "left").join(served.select("session_id", "rat", "at", "serving_freq", "serving_phy"), ["session_id", "rat", "at"], "left")
    # What the serving cell called itself by then: passports and questions of a cell in one ordered stream.
    mine = placed.select(*KEY, "at", "cid").unionByName(out.select("session_id", "rat", F.col("serving_freq").alias("freq"), F.col("serving_phy").alias("phy"), "at", F.lit(None).cast("long").alias("cid")))
    known = mine.withColumn("_serving_cid", F.first("cid", ignorenulls=True).over(_before(*KEY))).filter("cid is null").select("session_id", "rat", "at", "_serving_cid")
    out = out.join(known, ["session_id", "rat", "at"], "left")
    fits = F.col("serving_freq").isNotNull() & (_zero("cid") | _zero("_serving_cid") | _no(F.col("_serving_cid") == F.col("cid")))
    out = out.withColumn("_to", F.when(F.col("_home").isNotNull(), F.struct("_home.freq", "_home.phy")).when(fits, F.struct(F.col("serving_freq").alias("freq"), F.col("serving_phy").alias("phy"))))
    hint = F.lit(None).cast("struct<freq:int,phy:int>")
    if hints is not None:
        out, hint = _with_hint(out, hints, rows), F.col("_hint")
    waits = (F.col("rat") == "GSM") & F.col("cid").between(1, 0xFFFF)
    final = (
        F.when(F.col("_to").isNotNull(), F.col("_to")).when(hint.isNotNull(), hint)
        .when(waits & F.col("_later").isNotNull(), F.struct("_later.freq", "_later.phy")).when(waits, F.struct(F.lit(0).alias("freq"), F.col("cid").cast("int").alias("phy")))
    )
    absorbed = F.col("_to").isNull() & hint.isNull() & waits & F.col("_later").isNotNull()
    out = out.withColumn("_f", final).filter("_f is not null")
    out = out.withColumns({"at": F.when(absorbed, F.col("_later.at") - F.least("_left", F.lit(SUBS))).otherwise(F.col("at")), "freq": F.col("_f.freq").cast("int"), "phy": F.col("_f.phy").cast("int")})
    return rows.filter(~_no(loose)).unionByName(durable(out.select(*columns), "bound-passports"))


def _with_hint(asked: DataFrame, hints: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds _hint: the cell of the last hint before a passport that nothing else binds; the first such passport uses it up."""
    told = hints.select("session_id", (F.col("seq") * SUBS).cast("long").alias("_n"), F.col("freq").cast("int").alias("_arfcn")).withColumn("at", F.col("_n") * STEP)
    bare = asked.filter(F.col("_to").isNull() & (F.col("rat") == "GSM")).select("session_id", "at", "serving_freq")
    stream = bare.withColumn("_h", F.lit(None).cast("struct<at:bigint,freq:int>")).unionByName(told.select("session_id", "at", F.lit(None).cast("int").alias("serving_freq"), F.struct("at", F.col("_arfcn").alias("freq")).alias("_h")))
    last = stream.withColumns({"_is": F.col("_h").isNotNull(), "_h": F.last("_h", ignorenulls=True).over(_before("session_id"))}).filter("not _is and _h is not null and not (_h.freq <=> serving_freq)")
    used = last.withColumn("_r", F.row_number().over(W.partitionBy("session_id", "_h.at").orderBy("at"))).filter("_r = 1").select("session_id", "at", F.col("_h.freq").alias("_arfcn"))
    cells = rows.filter("rat = 'GSM' and freq <> 0 and phy <> 0").groupBy("session_id", F.col("freq").alias("_arfcn"), F.col("phy").alias("_bsic")).agg(F.min("at").alias("_first"))
    there = used.join(cells, ["session_id", "_arfcn"], "left").groupBy("session_id", "at", "_arfcn").agg(F.min(F.when(F.col("_first") < F.col("at"), F.col("_bsic"))).alias("_bsic"))
    found = there.select("session_id", "at", F.lit("GSM").alias("rat"), F.struct(F.col("_arfcn").alias("freq"), F.coalesce("_bsic", F.lit(0)).alias("phy")).alias("_hint"))
    return asked.join(found, ["session_id", "rat", "at"], "left")


def promote_gsm(events: DataFrame) -> DataFrame:
    """GSM rows of a channel without a code (phy 0) are taken over by the next neighbour report that knows a code of the channel.

    Levels are taken only by a cell that has none, radio parameters only by a new one.
    """
    rows = with_at(events)
    gsm = (F.col("rat") == "GSM") & (F.col("kind") != "neighbour")
    weak = gsm & ~_zero("freq") & _zero("phy")
    waiting = rows.filter(weak)
    channels = waiting.select(*CARRIER).distinct()
    there = rows.filter(gsm & ~_zero("phy")).select(*CARRIER, "phy", "at", "kind").join(channels, CARRIER, "left_semi")
    turn = F.when((F.col("kind") == "told") & ~_zero("phy"), F.struct("phy", "at"))
    stream = waiting.select(*CARRIER, "phy", "at", "kind").unionByName(there)
    turns = stream.withColumn("_next", _next(turn, *CARRIER)).filter(_zero("phy")).select(*CARRIER, "at", F.col("_next.phy").alias("_to"), F.col("_next.at").alias("_waits"))
    own = there.groupBy(*CARRIER, F.col("phy").alias("_to")).agg(F.min(F.when(F.col("kind").isin("signal", "heard"), F.col("at"))).alias("_own"), F.min("at").alias("_born"))
    moved = waiting.join(turns, [*CARRIER, "at"])
    met = _hushed(moved, own)
    old = (F.col("kind") == "radio") & _no(F.col("_born") < F.col("_waits"))
    found = met.withColumns({"kind": F.when(old, "silent").otherwise(F.col("kind")), "phy": F.coalesce("_to", "phy"), "waited": F.col("_to").isNotNull()})
    return rows.filter(~_no(weak)).unionByName(durable(found.select(*rows.columns), "gsm-resolved"))


# ---- identity with fan-out and claims -----------------------------------------------------------


def soft_plmns(births: DataFrame, events: DataFrame) -> DataFrame:
    """KEY, at, mcc, mnc: the first PLMN announced on an LTE carrier after a row of it appeared.

    ``births``: session_id, freq, phy, at.  Announcements and births are one
    ordered stream per carrier, not a range join.
    """
    told = with_at(events).filter("kind = 'passport' and rat = 'LTE' and phy <> 0 and mcc <> 0").select(*CARRIER, "at", F.struct("mcc", "mnc", "at").alias("_p"), F.lit(None).cast("int").alias("phy"))
    born = births.select(*CARRIER, "at", F.lit(None).cast(told.schema["_p"].dataType).alias("_p"), "phy")
    ordered = W.partitionBy(*CARRIER).orderBy(F.desc("at"), F.col("phy").isNull()).rowsBetween(W.unboundedPreceding, -1)
    found = told.unionByName(born).withColumn("_p", F.when(F.col("phy").isNotNull(), F.last("_p", ignorenulls=True).over(ordered))).filter("phy is not null and phy <> 0 and _p is not null")
    return found.select("session_id", F.lit("LTE").alias("rat"), "freq", "phy", "_p.at", "_p.mcc", "_p.mnc")


def lost_ids(events: DataFrame) -> DataFrame:
    """KEY, at: a row loses its LTE cell id when another row claims it."""
    claims = with_at(events).filter(F.col("kind").isin("passport", "named") & (F.col("rat") == "LTE") & ~_zero("phy") & ~_zero("cid"))
    prior = F.lag(F.struct("freq", "phy")).over(W.partitionBy("session_id", "cid").orderBy("at"))
    moved = claims.withColumn("_p", prior).filter("_p is not null and (_p.freq <> freq or _p.phy <> phy)")
    return moved.select("session_id", "rat", F.col("_p.freq").alias("freq"), F.col("_p.phy").alias("phy"), "at")


def serving_times(events: DataFrame) -> DataFrame:
    """KEY, at, until, waited: when each cell served; the last of a session and technology has no end."""
    serving = with_at(events).filter("kind in ('serving', 'gone')")
    until = F.lead("at").over(W.partitionBy("session_id", "rat").orderBy("at"))
    return serving.select(*KEY, "at", "kind", until.alias("until"), "waited").filter("kind = 'serving'").drop("kind")


def _marks(events: DataFrame, births: DataFrame) -> DataFrame:
    """Everything that bears on a cell's identity, as one stream: p(assport), t(old PLMN), s(oft PLMN), x (id lost), b(egins), e(nds to serve)."""
    rows = with_at(events)
    extra = [*M.fields(M.present(M.PASSPORT, rows.columns)), *(f for f in M.FLAGS if f in rows.columns)]
    own = rows.filter(F.col("kind").isin("passport", "named")).select(*KEY, "at", F.lit("p").alias("what"), (F.col("waited") | (F.col("kind") == "named")).alias("waited"), *M.IDENTITY, *extra)
    told = rows.filter((F.col("kind") == "told") & M.has_plmn()).select(*KEY, "at", F.lit("t").alias("what"), "mcc", "mnc")
    soft = soft_plmns(births, rows).select(*KEY, "at", F.lit("s").alias("what"), "mcc", "mnc")
    lost = lost_ids(rows).select(*KEY, "at", F.lit("x").alias("what"))
    served = serving_times(rows)
    begins, ends = served.select(*KEY, "at", "waited", F.lit("b").alias("what")), served.filter("until is not null").select(*KEY, F.col("until").alias("at"), F.lit("e").alias("what"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (own, told, soft, lost, begins, ends))


def identities(events: DataFrame, births: DataFrame) -> DataFrame:
    """R3, R8, R9, R10 for each cell: mcc, mnc, tac, cid, plmn_source, passport fields, is_serving, ever_serving.

    One ordered stream per cell.  A cell's lives are cut where it loses its id:
    the last one says cell id and area.  The PLMN is the one of the last full
    identity that replaced an incomplete one, else the first that came, where
    one of its own goes before a soft one.  A cell ever served if it served and had
    an id at one time.
    """
    rows = _marks(events, births)
    order = F.col("what") != "e"  # a cell that serves again ends first
    run = W.partitionBy(*KEY).orderBy("at", order)
    upto, prior = run.rowsBetween(W.unboundedPreceding, 0), run.rowsBetween(W.unboundedPreceding, -1)
    what, what_in = lambda c: F.col("what") == c, lambda *c: F.col("what").isin(*c)
    p = what("p")
    rows = rows.withColumn("life", F.sum(F.when(what("x"), 1).otherwise(0)).over(upto))
    life = W.partitionBy(*KEY, "life").orderBy("at", order).rowsBetween(W.unboundedPreceding, -1)
    ever = lambda c, w: F.coalesce(F.max(c).over(w), F.lit(False))
    rows = rows.withColumns(
        {
            "_was": ever(p & M.has_cid(), life) & ever(p & M.has_tac(), life) & ever(M.has_plmn() & ~what("x"), prior),
            "_holds": F.last(F.when(p & M.has_cid(), True).when(what("x"), False), ignorenulls=True).over(upto),
            "_serves": F.last(F.when(what("b"), True).when(what("e"), False), ignorenulls=True).over(upto),
        }
    )
    at = F.col("at")
    won = p & M.is_full() & ~F.col("_was")
    extra = M.present(M.PASSPORT, rows.columns)
    flags = [f for f in M.FLAGS if f in rows.columns]
    open_ = p & (M.is_full() | (~F.col("_was") & (M.has_cid() | M.has_plmn())))
    first = lambda c, ok: F.min_by(c, F.when(ok, at))
    plmns = {"won": (F.max_by, won), "own": (F.min_by, p & M.has_plmn()), "told": (F.min_by, what("t")), "soft": (F.min_by, what("s"))}
    lives = rows.groupBy(*KEY, "life").agg(
        *(F.coalesce(F.max_by(c, F.when(won, at)), first(c, p & ok)).alias(c) for c, ok in (("cid", M.has_cid()), ("tac", M.has_tac()))),
        *(by(c, F.when(ok, at)).alias(f"{n}_{c}") for n, (by, ok) in plmns.items() for c in ("mcc", "mnc")),
        *((F.max if by is F.max_by else F.min)(F.when(ok, at)).alias(f"{n}_at") for n, (by, ok) in plmns.items()),
        *M.last_fields(extra, p, rows.columns), *(F.max_by(f, F.when(open_, at)).alias(f) for f in flags),
        *(F.max(F.when(p & F.expr(r.counts), at)).alias(f"_{r.fields[0]}_at") for r in extra), F.max(F.when(open_, at)).alias("_flags_at"),
        # Said when either comes to a cell that has the other; not by events that waited elsewhere.
        F.bool_or(_no("_holds") & _no("_serves") & what_in("p", "b") & ~_no("waited")).alias("ever_serving"), F.max_by("_serves", "at").alias("_serves"),
    )
    whole = lives.groupBy(*KEY).agg(
        *(F.max_by(c, "life").alias(c) for c in ("cid", "tac")),
        *(by(f"{n}_{c}", f"{n}_at").alias(f"{n}_{c}") for n, (by, _) in plmns.items() for c in ("mcc", "mnc")),
        *((F.max if by is F.max_by else F.min)(f"{n}_at").alias(f"{n}_at") for n, (by, _) in plmns.items()),
        *(F.max_by(r.fields[0], f"_{r.fields[0]}_at").alias(r.fields[0]) for r in extra), *(F.max_by(f, "_flags_at").alias(f) for f in flags),
        F.bool_or("ever_serving").alias("ever_serving"), F.max_by("_serves", "life").alias("is_serving"),
    )
    soon = F.least("own_at", "told_at", "soft_at")
    source = (
        F.when(F.col("won_at").isNotNull(), "won").when((F.col("told_at") == soon), "told")
        .when(F.col("own_at").isNotNull(), "own").when(F.col("soft_at").isNotNull(), "soft")
    )
    chosen = {c: F.coalesce(*(F.when(source == n, F.col(f"{n}_{c}")) for n in plmns)) for c in ("mcc", "mnc")}
    names = F.when(source.isin("won", "own"), "hard").when(source == "told", "neighbour").when(source == "soft", "fanout")
    return whole.select(*KEY, *(c.alias(n) for n, c in chosen.items()), "tac", "cid", names.alias("plmn_source"), *M.fields(extra), *flags, _no("is_serving").alias("is_serving"), _no("ever_serving").alias("ever_serving"))


def _births(events: DataFrame) -> DataFrame:
    return events.filter("rat = 'LTE' and kind not in ('neighbour', 'gone')").groupBy(*CARRIER, "phy").agg(F.min("at").alias("at"))


def serving_flags(events: DataFrame) -> DataFrame:
    """is_serving (the last serving cell of a session and technology) and ever_serving, of the cells that served."""
    rows = with_at(events)
    served = serving_times(rows).select(*KEY).distinct()
    return identities(rows, _births(rows)).join(served, KEY, "left_semi").select(*KEY, "is_serving", "ever_serving")


def bind_events(events: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """Events on their final cells.

    They are written once, before the late bindings; those write only the rows
    that they move, and everything else stays a scan of that table.
    """
    compiled_rows(events.sparkSession)
    placed = durable(expand_neighbours(teller_plmn(bind_serving(events))), "bound-events")
    bound = promote_gsm(promote_weak(bind_gsm(placed, hints)))
    bound._written_to = placed._written_to
    return bound


def build_registry(events: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """One row per cell with identity, levels, radio parameters, serving flags, counters and PLMN source."""
    return registry_of_bound(bind_events(events, hints))


def registry_of_bound(bound: DataFrame) -> DataFrame:
    """The registry of events that are bound already."""
    compiled_rows(bound.sparkSession)
    rows = with_at(bound).filter("kind not in ('neighbour', 'gone')")
    own = ~F.col("kind").isin("told", "heard", "named") | ((F.col("rat") == "GSM") & (F.col("kind") == "told"))
    heard = F.col("kind").isin("signal", "heard")
    radio = F.col("kind").isin("radio", "registration")
    # One pass and one shuffle for everything that depends on the cell's own values alone.
    cells = rows.groupBy(*KEY).agg(
        F.min("seq").alias("first_seq"), F.count(F.when(own, 1)).alias("seen"), F.max(F.when(own, F.col("seq"))).alias("last_seq"), *_times(rows.columns, own),
        *M.last_fields(M.SIGNAL, heard, rows.columns), *M.last_fields(M.RADIO, radio, rows.columns),
    )
    named = identities(rows, _births(rows))
    out = cells.join(named, KEY, "left")
    no = F.lit(False)
    return out.withColumns({"is_serving": F.coalesce("is_serving", no), "ever_serving": F.coalesce("ever_serving", no), "plmn_soft": _no(F.col("plmn_source") == "fanout")})

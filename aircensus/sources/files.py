"""Journals, cell CSVs, tower documents and scanner logs as tables, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import towers
from ..operators.merge import SOURCES

# The columns of a cell CSV, in order.
CSV_SCHEMA = (
    "rat string, band string, duplex string, arfcn int, pci int, bsic int, ncc int, bcc int, mcc int, mnc int, lac int, cid long, signal_dbm double, rsrq double,"
    " c1 double, c2 double, snr double, serving int, seen int, first_seen string, last_seen string, lat double, lon double, dl_freq_mhz double, ul_freq_mhz double,"
    " bandwidth int, ul_bw int, ul_arfcn int, enb_rnc_id int, ncell_id int, nb_lte int, nb_gsm int, nb_umts int, nb_lte_detail string, nb_gsm_detail string, nb_umts_detail string"
)
CSV_COLUMNS = [c.split()[0] for c in CSV_SCHEMA.split(", ")]
_CSV_TYPES = dict(c.split() for c in CSV_SCHEMA.split(", "))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """session_id, block, pos, line: the lines of text files, which Spark splits into blocks.

    A block is one split of a file and is read by one task from its start, so
    ``pos`` rises with the lines of a block, and blocks are ordered by where they start.
    """
    meta = F.col("_metadata")
    return spark.read.text(path).select(
        meta["file_path"].alias("session_id"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line")
    )


def _carried(blocks: DataFrame, **totals: Column) -> DataFrame:
    """Per block, what the blocks before it in its file add up to; a row for each block only."""
    before = W.partitionBy("session_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return blocks.select("session_id", "block", *(e.over(before).alias(c) for c, e in totals.items()))


def read_journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1: (packets, errors) of text journals; a file is one session.

    A header line names code, channel and cell; the next RAW line consumes it.
    ``#`` and blank lines are skipped; RAW lines without a header or with bad
    hex are errors.  Files are split like any text: windows run in one block of a
    file, and a header or number that crosses into the next block is carried by
    a row for each block.
    """
    key = ["session_id", "block"]
    order = W.partitionBy(*key).orderBy("pos")
    noted = F.trim("line").eqNullSafe("") | F.startswith(F.ltrim("line"), F.lit("#"))
    lines = _numbered_lines(spark, path).withColumns({"is_raw": ~noted & F.col("line").rlike(r"^\s*RAW:"), "is_head": ~noted & F.col("line").rlike(r"0x[0-9A-Fa-f]{4}\b")})
    last = F.max_by(F.struct("line", "is_raw"), F.when(F.col("is_raw") | F.col("is_head"), F.col("pos")))
    blocks = lines.groupBy(*key).agg(F.count("*").alias("n"), last.alias("last"))
    carried = _carried(blocks, lines_before=F.sum("n"), carry=F.last("last", ignorenulls=True))
    lines = lines.withColumn("line_no", F.row_number().over(order)).filter("is_raw or is_head")
    lines = lines.withColumn("own", F.lag(F.struct("line", "is_raw")).over(order)).join(carried, key)
    lines = lines.withColumns({"before": F.coalesce("own", "carry"), "line_no": F.col("line_no") + F.coalesce("lines_before", F.lit(0)) - 1})
    packets = lines.filter("is_raw").withColumn("hex", F.regexp_replace(F.regexp_extract("line", r"^\s*RAW:\s*(.*)$", 1), r"\s", ""))
    packets = packets.withColumns({"head": F.col("before.line"), "payload": F.try_to_binary("hex", F.lit("hex"))})
    bad = F.coalesce("before.is_raw", F.lit(True)) | F.col("payload").isNull() | (F.col("hex") == "")
    number = lambda pattern: F.regexp_extract("head", pattern, 1).try_cast("int")
    wall = F.when(F.locate("]", F.col("head")) >= 21, F.regexp_extract("head", r"\[([0-9 :-]{19})", 1).try_cast("timestamp"))
    good = packets.filter(~bad)
    counts = _carried(good.groupBy(*key).agg(F.count("*").alias("n")), packets_before=F.sum("n"))
    good = good.withColumn("nth", F.row_number().over(order)).join(counts, key).select(
        "session_id", (F.col("nth") + F.coalesce("packets_before", F.lit(0))).alias("seq"), F.conv(F.regexp_extract("head", r"0x([0-9A-Fa-f]{4})", 1), 16, 10).cast("int").alias("log_code"),
        wall.alias("wall_time"), "payload", number(r"(?i)e?arfcn=([0-9]+)").alias("hdr_earfcn"), number(r"(?i)pci=([0-9]+)").alias("hdr_pci"), number(r"pdu=([0-9]+)").alias("hdr_pdu"),
    )
    return good, packets.filter(bad).select("session_id", "line_no", "line")


_GROUPS = {"nb_lte": ("meas", "intra", "inter"), "nb_gsm": ("gsm", "geran"), "nb_umts": ("wcdma", "utra"), "nb_nr": ("meas",)}


def _group(rat: Column, source: Column) -> Column:
    """Neighbour group of a document: by what the teller is and the source says."""
    return F.when(source.isin("gsm", "geran"), "nb_gsm").when(source.isin("wcdma", "utra"), "nb_umts").when(rat == "NR", "nb_nr").otherwise("nb_lte")


def _neighbour_texts(told: DataFrame) -> DataFrame:
    """Per cell: how many neighbours of each technology, and their list as text (``code:level``, ``channel/code:level``), by channel and code.

    Carriers that LTE cells advertise are not listed; a level is cut to a whole number.
    """
    level = F.coalesce(*(f"m_{c}" for c in ("rsrp", "rscp") if f"m_{c}" in told.columns), F.lit(None).cast("double")).cast("int")
    lte = _group(F.col("rat"), F.col("source")) == "nb_lte"
    name = F.when(lte, F.col("nb_phy").cast("string")).otherwise(F.concat_ws("/", "nb_freq", "nb_phy"))
    rows = told.filter("source <> 'inter'").select(*_KEY, _group(F.col("rat"), F.col("source")).alias("g"), "nb_freq", "nb_phy", F.concat_ws(":", name, level).alias("t"))
    out = rows.groupBy(*_KEY)
    parts = []
    for g in ("nb_lte", "nb_gsm", "nb_umts"):
        own = F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct("nb_freq", "nb_phy", "t"))))
        parts += [F.count_if(F.col("g") == g).cast("int").alias(g), F.array_join(F.transform(own, lambda x: x["t"]), ";").alias(f"{g}_detail")]
    return out.agg(*parts)


_KEY = ["session_id", "rat", "freq", "phy"]


def write_cells_csv(registry: DataFrame, path: str, told: DataFrame | None = None) -> None:
    """A5: registry rows as cell CSV; what is not set is blank; GSM fills bsic, ncc and bcc, the rest pci.

    ``told`` (``registry.told_neighbours``) fills the neighbour counts and lists.
    """
    gsm, lte = F.col("rat") == "GSM", F.col("rat") == "LTE"
    band = S.lte_band("freq")
    level = F.coalesce(*(c for c in ("rscp", "rxlev") if c in registry.columns), F.lit(None).cast("double"))
    values = {
        "rat": F.col("rat"), "arfcn": F.col("freq"), "pci": F.when(~gsm, F.col("phy")), "bsic": F.when(gsm, F.col("phy")),
        "ncc": F.when(gsm, F.shiftright("phy", 3)), "bcc": F.when(gsm, F.col("phy").bitwiseAND(7)),
        "band": F.when(lte, band["name"]), "duplex": F.when(lte, band["duplex"]), "dl_freq_mhz": F.when(lte, band["dl_mhz"]), "ul_freq_mhz": F.when(lte, band["ul_mhz"]),
        "mcc": F.nullif("mcc", F.lit(0)), "mnc": F.when(F.col("mcc") != 0, F.col("mnc")), "lac": F.nullif("tac", F.lit(0)), "cid": F.nullif("cid", F.lit(0)),
        "signal_dbm": F.coalesce("rsrp", level).cast("int").cast("double"), "serving": F.col("is_serving").cast("int"), "seen": F.col("seen"),
        "first_seen": F.col("first_seq").cast("string"), "last_seen": F.col("last_seq").cast("string"), "enb_rnc_id": F.when(lte, S.enb_id("cid")).otherwise(S.rnc_id("cid")),
        **{c: F.col(c) for c in ("rsrq", "snr", "c1", "c2", "bandwidth") if c in registry.columns}, **({"ul_arfcn": F.col("ul_freq")} if "ul_freq" in registry.columns else {}),
    }
    rows = registry
    if told is not None:
        rows = registry.join(_neighbour_texts(told), _KEY, "left")
        values |= {c: F.nullif(F.col(c), F.lit(0)) for c in ("nb_lte", "nb_gsm", "nb_umts")} | {f"{c}_detail": F.nullif(F.col(f"{c}_detail"), F.lit("")) for c in ("nb_lte", "nb_gsm", "nb_umts")}
    rows.select(*(values.get(c, F.lit(None)).cast(_CSV_TYPES[c]).alias(c) for c in CSV_COLUMNS)).write.csv(path, header=True)


def read_cells_csv(spark: SparkSession, path: str) -> DataFrame:
    """A2: cell CSVs with columns by header name; a ``sep=`` line, byte-order mark and carriage returns are dropped.

    Values that do not parse become null; rows without a technology are dropped.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", "").alias("value"))
    parsed = lines.filter("not startswith(value, 'sep=') and value <> ''").select(F.from_csv("value", F.lit(", ".join(f"{c} string" for c in CSV_COLUMNS)), {"quote": '"'}).alias("r")).select("r.*")
    typed = parsed.filter("rat is not null and trim(rat) not in ('', 'rat')")
    return typed.select(*(F.col(c) if _CSV_TYPES[c] == "string" else F.col(c).try_cast(_CSV_TYPES[c]).alias(c) for c in CSV_COLUMNS))


_MAP = "map<string,string>"
_N = f"array<struct<rat:string,resolved:string,identity:{_MAP},radio:{_MAP},signal:{_MAP}>>"
_T = f"struct<key:string,meta:{_MAP},identity:{_MAP},radio:{_MAP},signal:{_MAP},neighbors:struct<nb_lte:{_N},nb_gsm:{_N},nb_umts:{_N},nb_nr:{_N}>>"
TOWER_SCHEMA = f"meta {_MAP}, towers struct<gsm:array<{_T}>,lte:array<{_T}>,wcdma:array<{_T}>,nr:array<{_T}>>"
_NAMES = {"LTE": ("earfcn", "pci", "tac"), "WCDMA": ("uarfcn", "psc", "lac"), "GSM": ("arfcn", "bsic", "lac"), "NR": ("nrarfcn", "pci", "tac")}


def _text(c) -> F.col:
    return F.coalesce(c.cast("string"), F.lit(""))


def tower_rows(registry: DataFrame) -> DataFrame:
    """Registry rows as tower structs: every leaf is text, names follow the technology."""
    out = None
    for rat, (channel, code, area) in _NAMES.items():
        rows = registry.filter(F.col("rat") == rat)
        tower = F.struct(
            F.concat_ws("|", "rat", "freq", "phy").alias("key"),
            F.create_map(F.lit("serving"), F.when(F.col("is_serving"), "1").otherwise("0"), F.lit("camped"), F.when(F.col("ever_serving"), "1").otherwise("0"), F.lit("seen"), _text(F.col("seen")), F.lit("last_seen"), _text(F.col("last_seq"))).alias("meta"),
            F.create_map(F.lit("mcc_mnc"), S.format_plmn("mcc", "mnc"), F.lit(area), _text(F.nullif("tac", F.lit(0))), F.lit("cid"), _text(F.nullif("cid", F.lit(0)))).alias("identity"),
            F.create_map(F.lit(channel), _text(F.col("freq")), F.lit(code), _text(F.col("phy"))).alias("radio"),
            F.create_map(F.lit("rxl"), _text(F.coalesce("rsrp", *(c for c in ("rscp", "rxlev") if c in registry.columns)))).alias("signal"),
        )
        part = rows.select("session_id", F.lit(rat).alias("rat"), "freq", "phy", tower.alias("tower"))
        out = part if out is None else out.unionByName(part)
    return out


def _neighbour_groups(registry: DataFrame, told: DataFrame) -> DataFrame:
    """KEY, neighbors: the resolved neighbours of each cell as the four groups of a document."""
    found = towers.resolve_neighbours(registry, towers.with_carriers(told))
    group = _group(F.col("rat"), F.col("source"))
    rat = F.when(group == "nb_gsm", "GSM").when(group == "nb_umts", "WCDMA").when(group == "nb_nr", "NR").otherwise("LTE")
    names = {k: reduce(lambda e, r: e.when(F.col("nb_rat") == r, _NAMES[r][i]), _NAMES, F) for i, k in enumerate(("channel", "code", "area"))}
    text = lambda c: _text(F.col(c)) if c in found.columns else F.lit("")
    level = F.coalesce(*(F.col(c) for c in ("nb_rsrp", "m_rscp") if c in found.columns))
    one = F.struct(
        F.col("nb_rat").alias("rat"), F.when(F.col("resolved"), "1").otherwise("0").alias("resolved"),
        F.create_map(F.lit("mcc_mnc"), _text(S.format_plmn("nb_mcc", "nb_mnc")), names["area"], text("nb_tac"), F.lit("cid"), text("nb_cid")).alias("identity"),
        F.create_map(names["channel"], _text(F.col("nb_freq")), names["code"], _text(F.col("nb_phy"))).alias("radio"),
        F.create_map(F.lit("rxl"), _text(level), F.lit("rsrq"), text("nb_rsrq")).alias("signal"),
    )
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), F.lit(99))
    rows = found.withColumns({"nb_rat": rat, "_g": group}).select(*_KEY, "_g", rank.alias("_r"), "nb_freq", F.coalesce("nb_phy", F.lit(-1)).alias("_p"), one.alias("_n"))
    # Sorted by what can be compared; the maps ride along, found by place.
    order = F.row_number().over(W.partitionBy(*_KEY, "_g").orderBy("_r", "nb_freq", "_p"))
    placed = rows.withColumn("_i", order).groupBy(*_KEY, "_g").agg(F.map_from_entries(F.collect_list(F.struct("_i", "_n"))).alias("_m"))
    listed = placed.withColumn("_l", F.transform(F.sequence(F.lit(1), F.size("_m")), lambda i: F.element_at("_m", i)))
    own = lambda g: F.coalesce(F.first(F.when(F.col("_g") == g, F.col("_l")), ignorenulls=True), F.array()).alias(g)
    return listed.groupBy(*_KEY).agg(*(own(g) for g in _GROUPS)).select(*_KEY, F.struct(*_GROUPS).alias("neighbors"))


def tower_documents(registry: DataFrame, told: DataFrame | None = None, mode: str = "survey") -> DataFrame:
    """session_id, rat, channel, document (JSON text): nested towers of one carrier of a session.

    ``mode`` ``complete`` keeps the unique complete towers of a session (I1),
    ``survey`` one per technology, channel and code (I2).  ``told`` gives each tower
    its neighbour groups.  A document holds a carrier, whose codes bound its size.
    """
    kept = {"complete": towers.unique_complete, "survey": towers.unique_rf}[mode](registry, scope=["session_id"])
    rows = tower_rows(kept)
    if told is not None:
        rows = rows.join(_neighbour_groups(registry, told), _KEY, "left").withColumn("tower", F.col("tower").withField("neighbors", F.col("neighbors")))
    groups = [F.coalesce(F.collect_list(F.when(F.col("rat") == r, F.col("tower"))), F.array()).alias(r.lower()) for r in ("GSM", "LTE", "WCDMA", "NR")]
    meta = F.create_map(F.lit("source"), _text(F.col("session_id")), F.lit("mode"), F.lit(mode), F.lit("tower_count"), _text(F.count("*")))
    made = rows.groupBy("session_id", "rat", F.col("freq").alias("channel")).agg(meta.alias("meta"), F.struct(*groups).alias("towers"))
    return made.select("session_id", "rat", "channel", F.to_json(F.struct("meta", "towers")).alias("document"))


def write_towers_json(registry: DataFrame, path: str, told: DataFrame | None = None, mode: str = "survey") -> None:
    """The documents of ``tower_documents``, one a line; ``read_towers_json`` reads them back."""
    tower_documents(registry, told, mode).select(F.col("document").alias("value")).write.text(path)


def read_tower_neighbours(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """A3: the neighbours of the towers of documents: key, rat and group of the teller's list, then what is told of each."""
    docs = spark.read.schema(TOWER_SCHEMA).json(path, multiLine=not one_a_line)
    out = None
    for rat in ("gsm", "lte", "wcdma", "nr"):
        held = docs.select(F.explode(f"towers.{rat}").alias("t"))
        for group in _GROUPS:
            rows = held.select(F.col("t.key").alias("key"), F.lit(group).alias("nb_group"), F.posexplode(f"t.neighbors.{group}").alias("pos", "n"))
            out = rows if out is None else out.unionByName(rows)
    get = lambda m, k: F.coalesce(F.element_at(f"n.{m}", F.lit(k)), F.lit(""))
    return out.select(
        "key", "nb_group", "pos", F.col("n.rat").alias("nb_rat"), F.col("n.resolved").alias("resolved"), S.channel("n.radio").alias("channel"), S.cell_code("n.radio").alias("code"),
        get("identity", "cid").alias("cid"), get("signal", "rxl").alias("rxl"),
    )


def read_towers_json(spark: SparkSession, path: str, one_a_line: bool = False) -> DataFrame:
    """A3: tower documents (v4 and v5) flattened in the order GSM, LTE, WCDMA, NR; missing keys are ''.

    A file is one document, or has one on each line, which lets tasks share a file.
    """
    docs = spark.read.schema(TOWER_SCHEMA).json(path, multiLine=not one_a_line)
    out = None
    for place, rat in enumerate(("gsm", "lte", "wcdma", "nr")):
        rows = docs.select(F.lit(place).alias("rat_order"), F.lit(rat.upper()).alias("rat"), F.posexplode(f"towers.{rat}").alias("pos", "t"))
        out = rows if out is None else out.unionByName(rows)
    get = lambda m, k: F.coalesce(F.element_at(f"t.{m}", F.lit(k)), F.lit(""))
    return out.select(
        "rat_order", "pos", "rat", F.col("t.key").alias("key"), get("meta", "serving").alias("serving"), get("meta", "last_seen").alias("last_seen"),
        get("identity", "mcc_mnc").alias("mcc_mnc"), get("identity", "cid").alias("cid"), S.lac_or_tac("t.identity").alias("lac_or_tac"),
        S.channel("t.radio").alias("channel"), S.cell_code("t.radio").alias("code"), get("signal", "rxl").alias("rxl"),
    )


def parse_scanner_log(df: DataFrame, column: str = "line") -> DataFrame:
    """A4: (time, tag, message) of log lines.

    ``YYYY-MM-DD hh:mm:ss  tag message`` gives the clock time; ``#`` lines keep
    their whole text; others have no time.
    """
    c = F.col(column)
    dated = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} ([0-9:]{8})  "
    rest = F.regexp_replace(c, dated, "")
    comment = c.startswith("#")
    return df.select(
        "*", F.when(comment, "").otherwise(F.regexp_extract(c, dated, 1)).alias("time"),
        F.when(comment, "#").otherwise(F.regexp_extract(rest, r"^(\S+)", 1)).alias("tag"),
        F.when(comment, c).otherwise(F.regexp_replace(rest, r"^\S+\s*", "")).alias("message"),
    )


def run(pipeline, sinks) -> list:
    """L2: every sink gets the same written result of a pipeline."""
    from ..operators.durable import durable

    result = durable(pipeline(), "run-result")
    return [sink(result) for sink in sinks]


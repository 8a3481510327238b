"""Modem replies as tables: serving cells, neighbours, identities and operators from reply text.

Input: session_id, seq, reply (several lines, any line ends).  Everything is
built from SQL functions over arrays of lines and tokens; lines that do not
parse give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

KEY = ["session_id", "seq"]


def tagged_lines(df: DataFrame, tag: str) -> DataFrame:
    """KEY, pos, tok: the tokens of each line that starts with ``+tag:``, without blanks and quotes."""
    lines = F.regexp_extract_all("reply", F.lit(rf"\+{tag}:([^\r\n]*)"), F.lit(1))
    rows = df.select(*KEY, F.posexplode(lines).alias("pos", "line"))
    return rows.select(*KEY, "pos", F.split(F.regexp_replace("line", '[ "]', ""), ",").alias("tok"))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _tok(i: int) -> Column:
    return F.get("tok", i)


def _tenths(c: Column) -> Column:
    return _int(c) / 10


def _hex(c: Column) -> Column:
    digits = F.regexp_replace(c, "^0[xX]", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{1,8}$"), F.conv(digits, 16, 10).cast("int"))


# ---- T1: the full cell report ------------------------------------------------------------------


def parse_cmgrmi(df: DataFrame) -> DataFrame:
    """One row per cell of a report: kind 'serving' or 'neighbour', with identity, signal and timing.

    Signals are tenths of dB; values no cell can have are dropped.  Carrier
    numbers of LTE_Inter resolve the cells listed under them; of repeated
    neighbours the strongest stays; copies of the serving cell go.  All of a reply
    lies in its row, so array functions do it without a shuffle.
    """
    split = lambda line: F.split(F.regexp_replace(line, '[ "]', ""), ",")
    lines = df.select(*KEY, F.transform(F.regexp_extract_all("reply", F.lit(r"\+CMGRMI:([^\r\n]*)"), F.lit(1)), split).alias("lines"))
    tagged = lambda ok, size: F.filter("lines", lambda t: ok(F.get(t, 0)) & (F.size(t) >= size))

    def serving(t: Column) -> Column:
        ta = _int(F.get(t, 5))
        return F.struct(
            _int(F.get(t, 1)).alias("earfcn"), _int(F.get(t, 11)).alias("pci"), _int(F.get(t, 2)).alias("mcc"), _int(F.get(t, 3)).alias("mnc"), _int(F.get(t, 4)).alias("tac"),
            F.when(ta.between(1, 1282), ta).alias("ta"), _long(F.get(t, 6)).alias("cid"), S.bw_from_index(_int(F.get(t, 8))).alias("dl_bw"), _tenths(F.get(t, 12)).alias("rsrq"), _tenths(F.get(t, 13)).alias("rsrp"),
        )

    def whole(s: Column) -> Column:
        return S.valid_earfcn(s["earfcn"]) & s["pci"].between(1, 503) & S.sane_plmn(s["mcc"], s["mnc"]) & S.has_identity(s["cid"], s["tac"])

    # LTE_Inter: Freq<n>,<earfcn> pairs give each carrier number its channel.
    def pairs(t: Column) -> Column:
        named = F.transform(t, lambda x, i: F.struct(F.when(x.startswith("Freq"), _int(F.substring(x, 5, 9))).alias("n"), _int(F.get(t, i + 1)).alias("earfcn")))
        return F.filter(named, lambda p: p["n"].isNotNull() & S.valid_earfcn(p["earfcn"]))

    served = F.filter(F.transform(tagged(lambda x: x == "Serving_Cell", 14), serving), lambda s: F.coalesce(whole(s), F.lit(False)))
    known = lines.select(*KEY, "lines", F.get(served, F.size(served) - 1).alias("s"), F.flatten(F.transform(tagged(lambda x: x == "LTE_Inter", 1), pairs)).alias("carriers"))

    def cell(earfcn: Column, p: Column, q: Column, r: Column, source: str) -> Column:
        rsrq, rsrp = _tenths(q), _tenths(r)
        rsrp, rsrq = F.when(S.valid_rsrp(rsrp), rsrp), F.when(rsrq.between(-30, -1), rsrq)
        return F.struct(earfcn.alias("earfcn"), _int(p).alias("pci"), F.coalesce(rsrp, F.lit(-999.0)).alias("level"), rsrq.alias("rsrq"), rsrp.alias("rsrp"), F.lit(source).alias("source"))

    def inter(t: Column) -> Column:
        n = _int(F.regexp_extract(F.get(t, 0), "^LTE_InterFreq([0-9]+)_Cell", 1))
        channel = F.array_max(F.transform(F.filter("carriers", lambda c: c["n"] == n), lambda c: c["earfcn"]))
        return cell(channel, F.get(t, 1), F.get(t, 2), F.get(t, 3), "inter")

    told = F.concat(
        F.transform(tagged(lambda x: x == "CA_Scell", 9), lambda t: cell(_int(F.get(t, 1)), F.get(t, 2), F.get(t, 7), F.get(t, 8), "inter")),
        F.transform(tagged(lambda x: x.startswith("LTE_Intra_Cell"), 4), lambda t: cell(F.col("s.earfcn"), F.get(t, 1), F.get(t, 2), F.get(t, 3), "meas")),
        F.transform(tagged(lambda x: x.startswith("LTE_InterFreq"), 4), inter),
    )
    legal = lambda c: F.coalesce(S.valid_earfcn(c["earfcn"]) & c["pci"].between(1, 503), F.lit(False))
    own = lambda c: F.coalesce((c["earfcn"] == F.col("s.earfcn")) & (c["pci"] == F.col("s.pci")), F.lit(False))
    near = known.select(*KEY, "s", F.filter(told, lambda c: legal(c) & ~own(c)).alias("told"))
    same = lambda k: F.filter("told", lambda c: (c["earfcn"] == k["col1"]) & (c["pci"] == k["col2"]))
    best = F.transform(F.transform("told", lambda c: F.struct(c["earfcn"].alias("col1"), c["pci"].alias("col2"))), lambda k: F.array_max(same(k)))
    names = ("earfcn", "pci", "mcc", "mnc", "tac", "ta", "cid", "dl_bw", "rsrq", "rsrp")
    types = {"cid": "long", "rsrq": "double", "rsrp": "double"}

    def row(kind: str, get) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *(get(n).cast(types.get(n, "int")).alias(n) for n in names), get("source").cast("string").alias("source"))

    first = F.when(F.col("s").isNotNull(), F.array(row("serving", lambda n: F.lit(None) if n == "source" else F.col(f"s.{n}")))).otherwise(F.array())
    others = F.transform(F.array_distinct(best), lambda c: row("neighbour", lambda n: c[n] if n in ("earfcn", "pci", "rsrq", "rsrp", "source") else F.lit(None)))
    cells = near.select(*KEY, F.explode(F.concat(first, others)).alias("c"))
    return cells.select(*KEY, *(F.col(f"c.{n}").alias(n) for n in names), "c.source", "c.kind")


def cmgrmi_events(cells: DataFrame) -> DataFrame:
    """Events of parsed reports: radio, passport, signal and serving of the serving cell; radio and signal of the rest."""
    kinds = F.when(F.col("kind") == "serving", F.array(*map(F.lit, ("radio", "passport", "signal", "serving")))).otherwise(
        F.when(F.col("rsrp").isNotNull(), F.array(F.lit("radio"), F.lit("signal"))).otherwise(F.array(F.lit("radio")))
    )
    rows = cells.select(*KEY, F.lit("LTE").alias("rat"), F.col("earfcn").alias("freq"), F.col("pci").alias("phy"), "mcc", "mnc", "tac", "cid", "rsrp", F.posexplode(kinds).alias("sub_seq", "event"))
    own = lambda c, *kinds: F.when(F.col("event").isin(*kinds), F.col(c)).alias(c)
    return rows.select(*KEY, "sub_seq", "rat", "freq", "phy", F.col("event").alias("kind"), *(own(c, "passport") for c in ("mcc", "mnc", "tac", "cid")), own("rsrp", "signal"))


# ---- T3-T6: short replies ----------------------------------------------------------------------


def _plmn(c: Column) -> Column:
    return S.parse_plmn(c)


def parse_cpsi(df: DataFrame) -> DataFrame:
    """The last valid LTE or WCDMA line of a reply while online or limited."""
    rows = tagged_lines(df, "CPSI").filter((F.size("tok") >= 8) & (_tok(1).contains("Online") | _tok(1).contains("Limited")))
    rows = rows.withColumn("plmn", _plmn(_tok(2)))
    common = [*KEY, "pos", "plmn.mcc", "plmn.mnc", _hex(_tok(3)).alias("tac"), _long(_tok(4)).alias("cid")]
    lte = rows.filter(_tok(0) == "LTE").select(*common, F.lit("LTE").alias("rat"), _int(_tok(7)).alias("freq"), _int(_tok(5)).alias("phy"), _tenths(_tok(11)).alias("level"))
    lte = lte.filter(S.valid_earfcn("freq") & F.col("phy").between(1, 503))
    raw = _int(_tok(10))
    level = F.when(raw.between(0, 120), raw - 116).otherwise(raw).cast("double")
    wcdma = rows.filter(_tok(0) == "WCDMA").select(*common, F.lit("WCDMA").alias("rat"), _int(_tok(7)).alias("freq"), _int(_tok(6)).alias("phy"), level.alias("level"))
    wcdma = wcdma.filter(F.col("freq").between(1, 16383) & F.col("phy").between(0, 511))
    valid = lte.unionByName(wcdma).filter("mcc >= 100 and cid <> 0 and tac <> 0")
    return valid.groupBy(*KEY, "rat").agg(F.max_by(F.struct("mcc", "mnc", "tac", "cid", "freq", "phy", "level"), "pos").alias("s")).select(*KEY, "rat", "s.*")


def parse_cereg(df: DataFrame) -> DataFrame:
    """T4: area and cell id in hex of a registration reply; rows without both are dropped."""
    line = F.regexp_replace(F.regexp_extract("reply", r"\+C(?:E|G)?REG:([^\r\n]*)", 1), '[ "]', "")
    tok = F.split(line, ",")
    out = df.select(*KEY, _hex(F.get(tok, 2)).alias("tac"), _hex(F.get(tok, 3)).cast("long").alias("cid"))
    return out.filter("tac <> 0 and cid <> 0")


def parse_cnwinfo(df: DataFrame) -> DataFrame:
    """T4: mcc, mnc and cell id of a network report; two digits of mnc are tried before three."""
    line = F.regexp_replace(F.regexp_extract("reply", r"\+CNWINFO:([^\r\n]*)", 1), '[ "]', "")
    id_text = F.get(F.split(line, ","), 1)
    two, three = F.substring(id_text, 6, 20).try_cast("long"), F.substring(id_text, 7, 20).try_cast("long")
    pick = F.when(S.valid_eci(two), F.struct(F.substring(id_text, 4, 2).try_cast("int").alias("mnc"), two.alias("cid"))).when(
        S.valid_eci(three), F.struct(F.substring(id_text, 4, 3).try_cast("int").alias("mnc"), three.alias("cid"))
    )
    out = df.filter(line.startswith("LTE,") & (F.length(id_text) >= 8)).select(*KEY, F.substring(id_text, 1, 3).try_cast("int").alias("mcc"), pick.alias("p"))
    return out.filter("mcc between 100 and 999 and p is not null").select(*KEY, "mcc", "p.*")


def parse_cops(df: DataFrame) -> DataFrame:
    """T5: the current operator's PLMN (the first quoted text)."""
    quoted = F.regexp_extract("reply", r'\+COPS:[^"]*"([^"]*)"', 1)
    return df.select(*KEY, S.parse_plmn(quoted).alias("p")).filter("p is not null").select(*KEY, "p.*")


def parse_cops_list(df: DataFrame) -> DataFrame:
    """T5: all quoted PLMNs of five or six digits, distinct and ascending, as 'mcc-mnc' joined by ','."""
    found = F.regexp_extract_all("reply", F.lit('"([0-9-]{5,7})"'), F.lit(1))
    parsed = F.filter(F.transform(found, lambda t: S.parse_plmn(t)), lambda p: p.isNotNull())
    listed = F.transform(F.array_sort(F.array_distinct(parsed)), lambda p: S.format_plmn(p["mcc"], p["mnc"]))
    return df.select(*KEY, F.array_join(listed, ",").alias("plmns"))


def observed_rat(df: DataFrame) -> DataFrame:
    """Technology that a reply shows: a valid LTE line, a valid WCDMA line, then names in order."""
    valid = parse_cpsi(df).groupBy(*KEY).agg(F.max(F.col("rat") == "LTE").alias("_l"), F.max(F.col("rat") == "WCDMA").alias("_w"))
    has = lambda *t: F.expr(" or ".join(f"contains(reply, '{x}')" for x in t))
    rat = (
        F.when(F.col("_l"), "LTE").when(F.col("_w"), "WCDMA").when(has("NR5G", "NR,"), "NR").when(has("LTE"), "LTE").when(has("WCDMA", "UMTS"), "WCDMA")
        .when(has("GSM"), "GSM").when(has("NO SERVICE", "No service"), "NO_SERVICE").otherwise("UNKNOWN")
    )
    return df.join(valid, KEY, "left").select(*KEY, rat.alias("observed"))


def matches_rat(observed: Column, wanted: Column) -> Column:
    return F.when(wanted.isin("LTE", "WCDMA", "GSM", "NR"), observed == wanted).otherwise(True)


# ---- T7, T8: observation rounds ----------------------------------------------------------------


def merge_rounds(obs: DataFrame) -> DataFrame:
    """Observations of several rounds, each key (rat, channel, code, cell) from its first round."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("rf_channel", "phy_id", "cell_id")]
    named = obs.withColumn("obs_key", F.concat_ws("|", "rat", *key))
    columns = [c for c in obs.columns if c != "session_id"]
    best = named.groupBy("session_id", "obs_key").agg(F.min_by(F.struct(*columns), F.struct("round", "seq")).alias("o"))
    return best.select("session_id", "obs_key", "o.*")


def qmi_events(obs: DataFrame) -> DataFrame:
    """What a serving LTE observation tells: neighbours measured on its channel, codes per foreign channel."""
    usable = obs.filter(F.col("rf_channel").isNotNull() & (F.col("phy_id").isNotNull() | F.col("cell_id").isNotNull()))
    serving = usable.filter("rat = 'LTE' and serving").select("session_id", "round", F.col("rf_channel").alias("freq"), F.col("phy_id").alias("phy"))
    others = usable.filter("rat = 'LTE' and not serving and phy_id is not null")
    joined = serving.join(others, ["session_id", "round"])
    kind = F.when(F.col("rf_channel") == F.col("freq"), "meas").otherwise("inter")
    return joined.groupBy("session_id", "round", "freq", "phy", kind.alias("source"), F.col("rf_channel").alias("nb_freq")).agg(F.array_sort(F.collect_set("phy_id")).alias("pcis"))

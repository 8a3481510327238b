"""Every registered query of the library proper, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import ranking, rollups, towers
from ..operators import registry as R
from ..operators.durable import durable, is_there
from . import sql
from .feed import observations

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn

    return add


def on_obs(name: str, select: str, where: str = "TRUE"):
    """Registers a query over the observations; the SQL twin is ``select`` over the same rows."""
    return register(name, f"WITH {sql.OBS} SELECT {select} FROM obs WHERE {where}")


def on_registry(name: str, body: str):
    return register(name, f"WITH {sql.REGISTRY}\n{body}")


#: Tables that queries of one application share: (application, path, name) -> table.
_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A written table that several queries need, made once for an application and a path."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED or not is_there(_SHARED[key]):
        _SHARED[key] = make()
    return _SHARED[key]


def bound_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "bound", lambda: R.bind_events(observations(spark, sf_dir)))


def registry_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir, "registry", lambda: durable(R.registry_of_bound(bound_of(spark, sf_dir)), "registry"))


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cell tells of its neighbours, of all sources."""
    return shared(spark, sf_dir, "lists", lambda: durable(R.told_neighbours(bound_of(spark, sf_dir)), "lists"))


def snapshot(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(registry, told) of one binding of the events."""
    return registry_of(spark, sf_dir), _lists(spark, sf_dir).filter("rat = 'LTE' and phy <> 0 and nb_phy between 1 and 503")


# ---- B: scalars --------------------------------------------------------------------------------


@on_obs("b1_raw_to_db", "seq, (seq % 2000) / 16 - 180 AS rsrp, (seq % 480) / 16 - 30 AS rsrq, (seq % 1600) / 16 - 110 AS rssi, (seq % 700) / 16 - 20 AS sinr, round((seq % 500) * 0.1::DOUBLE - 20, 6) AS snr")
def _(spark, d):
    n = F.col("seq")
    return observations(spark, d).select(
        "seq", S.ml1_rsrp(n % 2000).alias("rsrp"), S.ml1_rsrq(n % 480).alias("rsrq"), S.ml1_rssi(n % 1600).alias("rssi"),
        S.nr_sinr(n % 700).alias("sinr"), F.round(S.ftl_snr(n % 500), 6).alias("snr"),
    )


@on_obs(
    "b2_guards",
    "seq, freq BETWEEN 1 AND 262143 AS earfcn_ok, phy BETWEEN 0 AND 503 AS pci_ok, coalesce(cid BETWEEN 1 AND 268435455, FALSE) AS eci_ok,"
    " coalesce(tac BETWEEN 1 AND 65534, FALSE) AS tac_ok, rsrp BETWEEN -150 AND -40 AS rsrp_ok, mcc BETWEEN 100 AND 999 AND mnc BETWEEN 0 AND 999 AS plmn_ok",
)
def _(spark, d):
    return observations(spark, d).select(
        "seq", S.valid_earfcn("freq").alias("earfcn_ok"), S.valid_pci("phy").alias("pci_ok"), S.valid_eci("cid").alias("eci_ok"),
        S.valid_tac("tac").alias("tac_ok"), S.valid_rsrp("rsrp").alias("rsrp_ok"), S.sane_plmn("mcc", "mnc").alias("plmn_ok"),
    )


_PACK = (
    "CASE WHEN hi BETWEEN 1 AND 503 AND NOT lo BETWEEN 1 AND 503 THEN 'MSB' WHEN lo BETWEEN 1 AND 503 AND NOT hi BETWEEN 1 AND 503 THEN 'LSB'"
    " WHEN lo BETWEEN 1 AND 503 AND hi BETWEEN 1 AND 503 AND w % 128 > 7 THEN 'LSB' WHEN lo BETWEEN 1 AND 503 THEN 'LSB' ELSE 'MSB' END"
)


@register(
    "b3_unpack_pci",
    f"WITH {sql.OBS}, x AS (SELECT seq, ((seq * 37 + phy) % 65536)::INT AS w FROM obs), y AS (SELECT seq, w, w % 512 AS lo, (w // 128) % 512 AS hi, (w // 512) % 8 AS lp FROM x),"
    f" z AS (SELECT *, {_PACK} AS pack FROM y) SELECT seq, w AS word, CASE pack WHEN 'LSB' THEN lo ELSE hi END AS pci, CASE pack WHEN 'LSB' THEN lp ELSE w % 8 END AS prio, pack FROM z",
)
def _(spark, d):
    df = observations(spark, d).select("seq", ((F.col("seq") * 37 + F.col("phy")) % 65536).cast("int").alias("word"))
    return df.withColumn("c", S.unpack_pci("word")).select("seq", "word", "c.pci", "c.prio", "c.pack")


_BANDS = ", ".join(f"({b}, '{x}', {lo}, {hi}, {dl}::DOUBLE, {ul}::DOUBLE)" for b, x, lo, hi, dl, ul in S.LTE_BANDS)


@register(
    "b4_lte_band",
    f"WITH {sql.OBS}, b(band, duplex, lo, hi, dl, ul) AS (VALUES {_BANDS}) SELECT seq, freq, band::INT AS band, duplex, 'B' || band AS name, round(dl + 0.1::DOUBLE * (freq - lo), 4) AS dl_mhz,"
    " round(CASE duplex WHEN 'FDD' THEN ul ELSE dl END + 0.1::DOUBLE * (freq - lo), 4) AS ul_mhz FROM obs LEFT JOIN b ON freq BETWEEN lo AND hi WHERE rat = 'LTE'",
)
def _(spark, d):
    df = observations(spark, d).filter("rat = 'LTE'").withColumn("b", S.lte_band("freq"))
    return df.select("seq", "freq", "b.band", "b.duplex", "b.name", F.round("b.dl_mhz", 4).alias("dl_mhz"), F.round("b.ul_mhz", 4).alias("ul_mhz"))


@on_obs(
    "b5_umts_band",
    "seq, freq, CASE WHEN freq BETWEEN 10562 AND 10838 THEN 'B1' END AS name, CASE WHEN freq BETWEEN 10562 AND 10838 THEN freq / 5 END AS dl_mhz,"
    " CASE WHEN freq BETWEEN 10562 AND 10838 THEN (freq - 950) / 5 END AS ul_mhz", "rat = 'WCDMA'",
)
def _(spark, d):
    df = observations(spark, d).filter("rat = 'WCDMA'").withColumn("b", S.umts_band("freq"))
    return df.select("seq", "freq", "b.name", "b.dl_mhz", "b.ul_mhz")


@on_obs(
    "b6_gsm_band",
    "seq, seq % 1024 AS arfcn, CASE WHEN seq % 1024 <= 124 OR seq % 1024 >= 975 THEN 'GSM900' WHEN seq % 1024 BETWEEN 128 AND 251 THEN 'GSM850' WHEN seq % 1024 BETWEEN 259 AND 293 THEN 'GSM450'"
    " WHEN seq % 1024 BETWEEN 306 AND 340 THEN 'GSM480' WHEN seq % 1024 BETWEEN 512 AND 885 THEN CASE WHEN j % 2 = 1 THEN 'PCS1900' ELSE 'DCS1800' END END AS name",
)
def _(spark, d):
    return observations(spark, d).select("seq", (F.col("seq") % 1024).alias("arfcn"), S.gsm_band(F.col("seq") % 1024, F.col("j") % 2).alias("name"))


@register(
    "b7_gsm_c1c2",
    f"WITH {sql.OBS}, x AS (SELECT seq, (-110 + seq % 80)::INT AS rx, (j % 12)::INT AS acc, (seq % 32)::INT AS lvl, i % 2 = 1 AS dcs, (j % 5)::INT AS cro, CASE WHEN seq % 3 = 0 THEN 31 ELSE 4 END AS pt FROM obs),"
    " y AS (SELECT *, CASE WHEN dcs THEN CASE WHEN lvl <= 28 THEN 30 - 2 * lvl WHEN lvl = 29 THEN 36 WHEN lvl = 30 THEN 34 ELSE 32 END ELSE CASE WHEN lvl <= 2 THEN 39 WHEN lvl <= 19 THEN 39 - 2 * (lvl - 2) ELSE 5 END END AS pw FROM x),"
    " z AS (SELECT *, least(greatest(rx + 110, 0), 63) - acc - greatest(pw - CASE WHEN dcs THEN 30 ELSE 33 END, 0) AS c1 FROM y)"
    " SELECT seq, c1, CASE WHEN pt = 31 THEN c1 - 2 * cro ELSE c1 + 2 * cro END AS c2 FROM z",
)
def _(spark, d):
    band = F.when(F.col("i") % 2 == 1, "DCS1800").otherwise("GSM900")
    df = observations(spark, d).select("seq", S.gsm_c1((-110 + F.col("seq") % 80).cast("int"), F.col("j") % 12, (F.col("seq") % 32).cast("int"), band).alias("c1"), "j", F.when(F.col("seq") % 3 == 0, 31).otherwise(4).alias("pt"))
    return df.select("seq", "c1", S.gsm_c2("c1", F.col("j") % 5, "pt").alias("c2"))


@on_obs("b8_split_cid", "seq, (cid // 256) % 1048576 AS enb, cid % 256 AS sector, (cid // 65536) % 4096 AS rnc, cid % 65536 AS cid16")
def _(spark, d):
    return observations(spark, d).select("seq", S.enb_id("cid").alias("enb"), S.sector("cid").alias("sector"), S.rnc_id("cid").alias("rnc"), S.cid16("cid").alias("cid16"))


@on_obs("b9_plmn_text", "seq, mcc || '-' || lpad(mnc::VARCHAR, 2, '0') AS plmn, mcc AS mcc_back, mnc AS mnc_back, mcc || '-' || lpad(mnc::VARCHAR, 2, '0') AS normal")
def _(spark, d):
    df = observations(spark, d).select("seq", S.format_plmn("mcc", "mnc").alias("plmn"))
    return df.select("seq", "plmn", S.parse_plmn("plmn")["mcc"].alias("mcc_back"), S.parse_plmn("plmn")["mnc"].alias("mnc_back"), S.normalize_plmn(F.regexp_replace("plmn", "-", "")).alias("normal"))


@on_obs("b10_operator", "seq, CASE mnc WHEN 1 THEN 'MTS' WHEN 2 THEN 'MegaFon' WHEN 20 THEN 't2' ELSE 'Beeline' END AS label")
def _(spark, d):
    return observations(spark, d).select("seq", S.operator_label(S.format_plmn("mcc", "mnc")).alias("label"))


@on_obs("b11_rat_of_code", "seq, (seq * 7919) % 65536 AS code, CASE WHEN (seq * 7919) % 65536 >= 47104 THEN 'NR' WHEN ((seq * 7919) % 65536) // 4096 = 11 THEN 'LTE' WHEN ((seq * 7919) % 65536) // 4096 = 5 THEN 'GSM' WHEN ((seq * 7919) % 65536) // 4096 IN (4, 7) THEN 'WCDMA' ELSE 'UNKNOWN' END AS code_rat")
def _(spark, d):
    code = (F.col("seq") * 7919) % 65536
    return observations(spark, d).select("seq", code.alias("code"), S.rat_of_code(code).alias("code_rat"))


@on_obs("b12_ta_distance", "seq, CASE WHEN seq % 1283 <> 0 THEN floor((seq % 1283) * 78.125 + 0.5)::INT END AS metres")
def _(spark, d):
    return observations(spark, d).select("seq", S.ta_distance_m(F.col("seq") % 1283).alias("metres"))


_RADIO = "CASE WHEN rat = 'WCDMA' THEN freq BETWEEN 1 AND 16383 AND phy BETWEEN 0 AND 511 ELSE freq <> 0 AND phy <> 0 END"
_KNOWN = "coalesce(CASE WHEN rat = 'WCDMA' THEN cid <> 0 AND tac <> 0 ELSE cid BETWEEN 1 AND 268435455 AND tac BETWEEN 1 AND 65534 END, FALSE)"


@on_obs("b13_fill_status", f"seq, CASE WHEN {_RADIO} AND {_KNOWN} THEN 'FULL' WHEN {_RADIO} THEN 'PLMN' ELSE 'WEAK' END AS fill")
def _(spark, d):
    return observations(spark, d).select("seq", S.fill_status("rat", "freq", "phy", "mcc", "cid", "tac").alias("fill"))


@on_registry(
    "b14_completeness",
    "SELECT session_id, rat, freq, phy, coalesce(cid, 0) = 0 AS radio, coalesce(cid, 0) <> 0 AS full_class, coalesce(cid, 0) <> 0 AND (is_serving OR ever_serving) AS camped, is_serving AS serving,"
    " CASE WHEN plmn_source = 'fanout' AND coalesce(cid, 0) = 0 OR mcc IS NULL THEN '' ELSE mcc || '-' || lpad(mnc::VARCHAR, 2, '0') END AS trusted FROM reg",
)
def _(spark, d):
    reg = registry_of(spark, d)
    klass = lambda k: S.matches_completeness(k, "cid", "tac", "mcc", "is_serving", "ever_serving")
    return reg.select(*R.KEY, klass("Radio").alias("radio"), klass("Full").alias("full_class"), klass("Camped").alias("camped"), klass("Serving").alias("serving"), S.plmn_trusted("mcc", "mnc", "plmn_soft", "cid").alias("trusted"))


@on_obs(
    "b15_first_set",
    "seq, freq::VARCHAR AS channel, phy::VARCHAR AS code, coalesce(tac::VARCHAR, '') AS area, CASE WHEN seq % 2 = 0 THEN 'f' || seq ELSE 'i' || seq END AS rsrp_text",
)
def _(spark, d):
    t = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    is_lte, is_w = F.col("rat") == "LTE", F.col("rat") == "WCDMA"
    radio = F.create_map(
        F.lit("earfcn"), F.when(is_lte, t("freq")).otherwise(""), F.lit("uarfcn"), F.when(is_w, t("freq")).otherwise(""), F.lit("arfcn"), F.when(~is_lte & ~is_w, t("freq")).otherwise(""),
        F.lit("pci"), F.when(is_lte, t("phy")).otherwise(""), F.lit("psc"), F.when(is_w, t("phy")).otherwise(""), F.lit("bsic"), F.when(~is_lte & ~is_w, t("phy")).otherwise(""),
    )
    ident = F.create_map(F.lit("tac"), F.when(is_lte, t("tac")).otherwise(""), F.lit("lac"), F.when(~is_lte, t("tac")).otherwise(""))
    sig = F.create_map(F.lit("rsrp_filt"), F.when(F.col("seq") % 2 == 0, F.concat(F.lit("f"), "seq")).otherwise(""), F.lit("rxl"), F.concat(F.lit("i"), "seq"))
    df = observations(spark, d).select("seq", radio.alias("r"), ident.alias("n"), sig.alias("s"))
    return df.select("seq", S.channel("r").alias("channel"), S.cell_code("r").alias("code"), S.lac_or_tac("n").alias("area"), S.rsrp_display("s").alias("rsrp_text"))


_DUR = "CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END"


@register(
    "b16_spans",
    f"WITH {sql.OBS}, x AS (SELECT seq, (seq * 7000000000) % 20000000000000 // 1000000000 AS s, (seq * 7000000000) % 20000000000000 AS n FROM obs), y AS (SELECT seq, CASE WHEN n >= 1000000000 THEN s ELSE n END AS s FROM x)"
    f" SELECT seq, CASE WHEN s < 1 THEN 'seen <1s' ELSE 'seen ' || {_DUR} END AS span, CASE WHEN s < 2 THEN 'just now' ELSE {_DUR} || ' ago' END AS age FROM y",
)
def _(spark, d):
    late = ((F.col("seq") * 7_000_000_000) % 20_000_000_000_000 + 5).cast("string")
    return observations(spark, d).select("seq", S.format_span(F.lit("5"), late).alias("span"), S.format_age(F.lit("5"), late).alias("age"))


@on_obs("b17_bandwidth", "seq, CASE i WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 5 WHEN 3 THEN 10 WHEN 4 THEN 15 WHEN 5 THEN 20 END AS by_index, CASE (j % 7) * 25 WHEN 25 THEN 5 WHEN 50 THEN 10 WHEN 75 THEN 15 WHEN 100 THEN 20 ELSE (j % 7) * 25 END AS by_blocks")
def _(spark, d):
    return observations(spark, d).select("seq", S.bw_from_index("i").alias("by_index"), S.bw_from_nrb((F.col("j") % 7) * 25).alias("by_blocks"))


@on_obs("b18_bcd_lai", "seq, mcc AS lai_mcc, mnc AS lai_mnc, coalesce(tac, 0) AS lai_lac")
def _(spark, d):
    # 250-mn as BCD: 52 F0 <mnc nibbles swapped>, then the area code.
    mnc = F.lpad(F.col("mnc").cast("string"), 2, "0")
    raw = F.unhex(F.concat(F.lit("52F0"), F.reverse(mnc), F.lpad(F.hex(F.coalesce("tac", F.lit(0))), 4, "0")))
    df = observations(spark, d).select("seq", raw.alias("payload")).withColumn("l", S.decode_lai("payload"))
    return df.select("seq", F.col("l.mcc").alias("lai_mcc"), F.col("l.mnc").alias("lai_mnc"), F.col("l.lac").alias("lai_lac"))


# ---- R: registry -------------------------------------------------------------------------------


@register("r1_asof_serving", f"WITH {sql.OBS} SELECT session_id, seq, last_value(CASE WHEN kind = 'serving' THEN freq END IGNORE NULLS) OVER w AS serving_freq, last_value(CASE WHEN kind = 'serving' THEN phy END IGNORE NULLS) OVER w AS serving_phy FROM obs WINDOW w AS (PARTITION BY session_id, rat ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    return R.asof_serving(observations(spark, d)).select("session_id", "seq", "serving_freq", "serving_phy")


@register(
    "r2_seen_stats",
    f"WITH {sql.OBS} SELECT session_id, rat, freq, phy, count(*) AS seen, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(wall_time, seq) AS first_seen, arg_max(wall_time, seq) AS last_seen"
    " FROM obs WHERE kind <> 'neighbour' GROUP BY ALL",
)
def _(spark, d):
    return R.seen_stats(observations(spark, d))


_PASSPORTS = f"""WITH {sql.OBS},
p AS (SELECT *, cid IS NOT NULL AND tac IS NOT NULL AS whole, bool_or(cid IS NOT NULL) OVER w AND bool_or(tac IS NOT NULL) OVER w AND count(*) OVER w > 0 AS was FROM obs WHERE kind = 'passport'
  WINDOW w AS (PARTITION BY session_id, rat, freq, phy ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT session_id, rat, freq, phy, arg_min({{'mnc': mnc, 'tac': tac, 'cid': cid}}, seq) FILTER (WHERE whole AND NOT coalesce(was, FALSE)) AS won, arg_min(mnc, seq) AS mnc,
    arg_min(tac, seq) FILTER (WHERE tac IS NOT NULL) AS tac, arg_min(cid, seq) FILTER (WHERE cid IS NOT NULL) AS cid,
    arg_max(mnc_digits, seq) FILTER (WHERE mnc_digits IN (2, 3)) AS mnc_digits, arg_max(rac, seq) FILTER (WHERE rac <> 0) AS rac FROM p GROUP BY ALL)
SELECT session_id, rat, freq, phy, 250 AS mcc, coalesce(won.mnc, mnc) AS mnc, coalesce(won.tac, tac) AS tac, coalesce(won.cid, cid) AS cid, mnc_digits, rac FROM m"""


@register("r3_merge_passport", _PASSPORTS)
def _(spark, d):
    return R.merge_passport(observations(spark, d))


@register(
    "r4_latest_signal",
    f"WITH {sql.OBS}, x AS (SELECT *, seq AS tick FROM obs WHERE kind = 'signal') SELECT session_id, rat, freq, phy, {sql.LAST_LEVELS % {'among': 'TRUE'}} FROM x GROUP BY session_id, rat, freq, phy",
)
def _(spark, d):
    return R.latest_signal(observations(spark, d))


@register(
    "r5_latest_radio",
    f"WITH {sql.OBS}, x AS (SELECT *, seq AS tick FROM obs WHERE kind = 'radio')"
    f" SELECT session_id, rat, freq, phy, max(seq) AS radio_seq, {sql.LAST_PARAMETERS % {'among': 'TRUE'}} FROM x GROUP BY session_id, rat, freq, phy",
)
def _(spark, d):
    return R.latest_radio(observations(spark, d))


@register("r6_promote_weak", f"WITH {sql.PROMOTED} SELECT session_id, rat, seq, freq, phy, kind, cid, tac FROM promoted")
def _(spark, d):
    return R.promote_weak(R.expand_neighbours(observations(spark, d))).select("session_id", "rat", "seq", "freq", "phy", "kind", "cid", "tac")


@register("r7_bind_gsm", f"WITH {sql.OBS}, {sql.GSM_BOUND} SELECT session_id, seq, freq, phy, cid FROM bound")
def _(spark, d):
    loose = (F.col("rat") == "GSM") & (F.col("kind") == "passport") & (F.col("seq") % 20 < 10)
    obs = observations(spark, d).withColumn("freq", F.when(loose, 0).otherwise(F.col("freq")))
    return R.bind_gsm(obs).filter("rat = 'GSM' and kind = 'passport'").select("session_id", "seq", "freq", "phy", "cid")


@on_registry("r8_fanout_plmn", "SELECT session_id, freq, phy, mcc, mnc, plmn_source FROM reg WHERE rat = 'LTE'")
def _(spark, d):
    return registry_of(spark, d).filter("rat = 'LTE'").select("session_id", "freq", "phy", "mcc", "mnc", "plmn_source")


@on_registry("r9_claim_eci", "SELECT session_id, freq, phy, cid, tac FROM reg WHERE rat = 'LTE' AND cid IS NOT NULL")
def _(spark, d):
    return registry_of(spark, d).filter("rat = 'LTE' and cid is not null").select("session_id", "freq", "phy", "cid", "tac")


@on_registry("r10_serving_flags", "SELECT session_id, rat, freq, phy, is_serving, ever_serving FROM flags")
def _(spark, d):
    return R.serving_flags(bound_of(spark, d))


@on_registry("r11_neighbour_rows", "SELECT session_id, seq, nb_freq AS freq, nb_phy AS phy, CASE WHEN nb_freq = freq AND rat = 'LTE' THEN mcc END AS nb_mcc, phy AS from_phy FROM named WHERE TRUE")
def _(spark, d):
    return R.neighbour_rows(observations(spark, d)).select("session_id", "seq", "freq", "phy", "nb_mcc", "from_phy")


@on_registry("r12_neighbour_lists", "SELECT session_id, freq, phy, nb_freq, string_agg(DISTINCT nb_phy::VARCHAR, ',' ORDER BY nb_phy::VARCHAR) AS pcis, count(*) AS reports, arg_max(nb_thresh_high, seq) FILTER (WHERE nb_thresh_high <> 0) AS nb_thresh_high"
    " FROM obs WHERE kind = 'neighbour' AND rat = 'LTE' AND phy <> 0 AND nb_phy BETWEEN 1 AND 503 GROUP BY session_id, freq, phy, nb_freq")
def _(spark, d):
    lists = R.merge_neighbour_lists(observations(spark, d))
    return lists.select("session_id", "freq", "phy", "nb_freq", F.array_join(F.array_sort(F.transform("pcis", lambda x: x.cast("string"))), ",").alias("pcis"), "reports", "nb_thresh_high")


@on_registry(
    "r12_measured_neighbours",
    "SELECT session_id, freq, phy, nb_phy, count(*) AS reports, arg_max(rsrp, seq) AS rsrp, arg_max(rsrq, seq) AS rsrq, arg_max(rssi, seq) FILTER (WHERE rssi IS NOT NULL) AS rssi,"
    " arg_max(nb_offset, seq) FILTER (WHERE nb_offset <> 0) AS nb_offset FROM obs WHERE kind = 'neighbour' AND rat = 'LTE' AND nb_freq = freq AND nb_phy <= 503 GROUP BY session_id, freq, phy, nb_phy",
)
def _(spark, d):
    return R.merge_measured(observations(spark, d)).select("session_id", "freq", "phy", "nb_phy", "reports", "rsrp", "rsrq", "rssi", "nb_offset")


_REGISTRY = (
    "mcc mnc tac cid mnc_digits rac barred rsrp rsrq rssi snr rscp rxlev ul_freq bandwidth ta rrc_state emm_state emm_substate barring_emergency seen first_seq last_seq plmn_source is_serving ever_serving"
).split()


@on_registry("r13_registry", f"SELECT session_id, rat, freq, phy, {', '.join(_REGISTRY)} FROM reg")
def _(spark, d):
    return registry_of(spark, d).select(*R.KEY, *_REGISTRY)


# ---- F: predicates -----------------------------------------------------------------------------


@on_registry("f1_lte_rf", "SELECT session_id, freq, phy FROM reg WHERE rat = 'LTE' AND phy BETWEEN 1 AND 503 AND freq BETWEEN 1 AND 262143")
def _(spark, d):
    return registry_of(spark, d).filter(P.is_lte_rf()).select("session_id", "freq", "phy")


@on_registry("f2_full_cells", f"SELECT session_id, rat, freq, phy FROM reg WHERE {sql.FULL_LTE} OR {sql.FULL_WCDMA}")
def _(spark, d):
    return registry_of(spark, d).filter(P.is_full_lte() | P.is_full_wcdma()).select(*R.KEY)


@on_registry("f3_complete", f"SELECT session_id, rat, freq, phy FROM reg WHERE {sql.COMPLETE}")
def _(spark, d):
    return registry_of(spark, d).filter(P.is_complete()).select(*R.KEY)


@on_registry("f4_drop_ghosts", f"SELECT session_id, rat, freq, phy FROM reg WHERE NOT ({sql.GHOST})")
def _(spark, d):
    return P.drop_ghosts(registry_of(spark, d)).select(*R.KEY)


@on_registry("f5_scope_rats", "SELECT 'wcdma' AS scope, rat, count(*) AS cells FROM reg WHERE rat NOT IN ('LTE', 'NR') GROUP BY rat UNION ALL SELECT 'lte', rat, count(*) FROM reg WHERE rat <> 'WCDMA' GROUP BY rat")
def _(spark, d):
    reg = registry_of(spark, d)
    one = lambda m: P.scope_rats(reg, m).groupBy("rat").agg(F.count("*").alias("cells")).select(F.lit(m).alias("scope"), "rat", "cells")
    return one("wcdma").unionByName(one("lte"))


@on_registry("f6_query_towers", "SELECT session_id, rat, freq, phy, cid FROM reg WHERE rat IN ('LTE', 'NR') AND coalesce(cid, 0) <> 0 AND mnc = 1 AND mcc = 250")
def _(spark, d):
    return towers.query_towers(registry_of(spark, d), rats=["LTE", "NR"], with_cid=True, plmn="250-01", sort="rxl").select(*R.KEY, "cid")


@on_registry("f7_search_towers", "SELECT session_id, freq, phy FROM reg WHERE rat = 'LTE' AND freq = 6275 AND mcc = 250 AND mnc = 99 AND coalesce(cid, 0) <> 0")
def _(spark, d):
    return towers.search_towers(registry_of(spark, d), "earfcn6275  Beeline LTE cid5 ").select("session_id", "freq", "phy")


@on_registry("f8_lte_towers", f"SELECT session_id, mcc, mnc, tac, cid AS eci, freq AS earfcn, phy AS pci, ({sql.BAND})::INT AS band, rsrp, is_serving, ever_serving FROM reg WHERE {sql.FULL_LTE}")
def _(spark, d):
    return towers.lte_towers(registry_of(spark, d))


# ---- H: rollups --------------------------------------------------------------------------------


@on_registry("h1_survey_stats", f"SELECT count(*) FILTER (WHERE rat = 'LTE' AND phy BETWEEN 1 AND 503 AND freq BETWEEN 1 AND 262143) AS rf_unique, count(*) FILTER (WHERE {sql.FULL_LTE}) AS full_cells, count(DISTINCT cid // 256) FILTER (WHERE {sql.FULL_LTE}) AS sites, count(*) FILTER (WHERE rat = 'LTE' AND is_serving) AS serving FROM reg")
def _(spark, d):
    return rollups.survey_stats(registry_of(spark, d))


@on_registry("h2_operators", f"SELECT mcc, mnc, count(*) AS towers, count(DISTINCT cid // 256) AS sites FROM reg WHERE {sql.FULL_LTE} GROUP BY mcc, mnc")
def _(spark, d):
    return rollups.operators(registry_of(spark, d))


@on_registry("h3_coverage", "SELECT coalesce(rat, 'TOTAL') AS rat, count(*) AS cells, count(*) FILTER (WHERE is_serving) AS serving, count(*) FILTER (WHERE cid <> 0) AS with_cid, count(rsrp) AS with_signal FROM reg GROUP BY ROLLUP (rat)")
def _(spark, d):
    return rollups.coverage(registry_of(spark, d))


def _packets(spark, d):
    obs = observations(spark, d)
    code = F.when(F.col("rat") == "LTE", F.lit(0xB17F) + F.col("i")).when(F.col("rat") == "NR", 0xB823).when(F.col("rat") == "GSM", 0x5134).otherwise(0x4127)
    return obs.select("session_id", "seq", code.alias("log_code"), F.when(F.col("seq") % 11 != 0, F.col("j") % 3).alias("events"), (F.col("seq") % 13 == 0).alias("error"))


_PACKETS = "pk AS (SELECT session_id, seq, CASE rat WHEN 'LTE' THEN 45439 + i WHEN 'NR' THEN 47139 WHEN 'GSM' THEN 20788 ELSE 16679 END AS log_code, CASE WHEN seq % 11 <> 0 THEN j % 3 END AS events, seq % 13 = 0 AS error FROM obs)"
_CODES = "cs AS (SELECT log_code, count(*) AS fed, count(*) FILTER (WHERE events > 0) AS accepted, count(*) FILTER (WHERE error) AS rejected, count(*) FILTER (WHERE events = 0 AND NOT error) AS empty, count(*) FILTER (WHERE events IS NULL) AS unparsed FROM pk GROUP BY log_code)"


@register(
    "h4_code_stats",
    f"WITH {sql.OBS}, {_PACKETS}, {_CODES} SELECT *, accepted * 100 // fed AS ok_percent, CASE WHEN unparsed = fed THEN 'no parser' WHEN accepted = fed THEN 'OK events' WHEN accepted > 0 THEN 'partial' WHEN rejected > 0 THEN 'errors' WHEN empty > 0 THEN 'empty' ELSE 'seen' END AS verdict,"
    " CASE WHEN log_code >= 47104 THEN 'NR' WHEN log_code // 4096 = 11 THEN 'LTE' WHEN log_code // 4096 = 5 THEN 'GSM' ELSE 'WCDMA' END AS rat FROM cs",
)
def _(spark, d):
    return rollups.code_stats(_packets(spark, d))


@on_registry(
    "h6_dump_stats",
    f"SELECT CASE WHEN grouping(rat) = 0 THEN 'rat' WHEN grouping(band) = 0 THEN 'band' WHEN grouping(plmn) = 0 THEN 'plmn' ELSE 'total' END AS kind, coalesce(rat, band::VARCHAR, plmn, '') AS value, count(*) AS cells, count(*) FILTER (WHERE is_serving) AS serving, max(last_seq) AS latest"
    f" FROM (SELECT rat, CASE WHEN rat = 'LTE' THEN {sql.BAND} END AS band, CASE WHEN mcc IS NULL THEN '' ELSE mcc || '-' || lpad(mnc::VARCHAR, 2, '0') END AS plmn, is_serving, last_seq FROM reg) GROUP BY GROUPING SETS ((rat), (band), (plmn), ())",
)
def _(spark, d):
    return rollups.dump_stats(registry_of(spark, d))


@on_registry(
    "h7_site_tree",
    "SELECT mcc || '-' || lpad(mnc::VARCHAR, 2, '0') AS plmn, (cid // 256) % 1048576 AS enb, count(*) AS cells, max(rsrp) AS best_rsrp, arg_min(tac, (freq, phy, session_id)) AS tac,"
    " string_agg(freq || '/' || phy, ';' ORDER BY is_serving DESC, ever_serving DESC, coalesce(rsrp, -999) DESC, freq, phy, session_id) AS cell_list FROM reg WHERE rat = 'LTE' AND cid <> 0 GROUP BY 1, 2",
)
def _(spark, d):
    return rollups.site_tree(registry_of(spark, d))


@on_registry("h8_document_meta", f"SELECT max(last_seq) AS situation_as_of, count(*) AS raw_tower_count, count(*) FILTER (WHERE {sql.COMPLETE}) AS tower_count, count(*) FILTER (WHERE is_serving) AS serving_count, count(*) FILTER (WHERE rat = 'GSM') AS gsm, count(*) FILTER (WHERE rat = 'LTE') AS lte, count(*) FILTER (WHERE rat = 'WCDMA') AS wcdma, count(*) FILTER (WHERE rat = 'NR') AS nr FROM reg")
def _(spark, d):
    return rollups.document_meta(registry_of(spark, d))


@on_registry("h9_frontier_counts", f"SELECT session_id, freq, full_on_earfcn, max_plmn_camps FROM frontier")
def _(spark, d):
    return rollups.frontier_counts(registry_of(spark, d))


@on_registry("h11_wcdma_stats", f"SELECT count(*) FILTER (WHERE rat = 'WCDMA' AND freq BETWEEN 1 AND 16383 AND phy BETWEEN 0 AND 511) AS rf, count(*) FILTER (WHERE {sql.FULL_WCDMA}) AS full_cells FROM reg")
def _(spark, d):
    return rollups.wcdma_stats(registry_of(spark, d))


@on_registry("h12_band_list", f"SELECT session_id, array_to_string(list_sort(list_distinct(list({sql.BAND}) || [1, 8])), ':') AS bands FROM reg WHERE rat = 'LTE' AND ({sql.BAND}) IS NOT NULL GROUP BY session_id")
def _(spark, d):
    return rollups.band_list(registry_of(spark, d).filter("rat = 'LTE'"))


@register("h13_diag_top", f"WITH {sql.OBS}, {_PACKETS}, {_CODES} SELECT string_agg(printf('%X:%d/%d', log_code::BIGINT, fed, accepted), ',' ORDER BY fed DESC, log_code) AS diag_top FROM (SELECT * FROM cs ORDER BY fed DESC, log_code LIMIT 8)")
def _(spark, d):
    return rollups.diag_top(rollups.code_stats(_packets(spark, d)))


# ---- G: joins ----------------------------------------------------------------------------------


@on_registry(
    "g1_resolve_neighbours",
    "SELECT t.session_id, t.freq, t.phy, t.nb_freq, t.nb_phy, r.cid AS nb_cid, coalesce(m_rsrp, r.rsrp) AS nb_rsrp, coalesce(m_rsrq, r.rsrq) AS nb_rsrq, r.phy IS NOT NULL AS resolved FROM told t LEFT JOIN reg r ON r.session_id = t.session_id AND r.rat = t.rat AND r.freq = t.nb_freq AND r.phy = t.nb_phy WHERE NOT (t.nb_freq = t.freq AND t.nb_phy = t.phy)",
)
def _(spark, d):
    out = towers.resolve_neighbours(*snapshot(spark, d))
    return out.select("session_id", "freq", "phy", "nb_freq", "nb_phy", "nb_cid", "nb_rsrp", "nb_rsrq", "resolved")


@on_registry(
    "g2_neighbour_sources",
    "SELECT session_id, rat, freq, phy, nb_freq, nb_phy, source, reports FROM lists WHERE NOT coalesce(nb_freq = freq AND nb_phy = phy, FALSE)"
    " UNION ALL SELECT DISTINCT session_id, rat, freq, phy, nb_freq, NULL::INT, 'inter', 0 FROM lists l WHERE source = 'inter' AND nb_phy IS NOT NULL"
    " AND NOT EXISTS (FROM lists k WHERE k.session_id = l.session_id AND k.rat = l.rat AND k.freq = l.freq AND k.phy = l.phy AND k.nb_freq = l.nb_freq AND k.nb_phy IS NULL AND k.source = 'inter')",
)
def _(spark, d):
    out = towers.resolve_neighbours(registry_of(spark, d), towers.with_carriers(_lists(spark, d)))
    return out.select(*R.KEY, "nb_freq", "nb_phy", "source", "reports")


def _sides(spark, d):
    """Two surveys: the cells of the even and of the odd sessions, each cell as its latest session has it."""
    cells = registry_of(spark, d).select("session_id", *towers.IDENTITY, "rsrp", "last_seq", "is_serving", F.coalesce("last_seq", "first_seq").alias("row_no"))
    latest = W.partitionBy(F.col("session_id") % 2, "rat", "freq", "phy").orderBy(F.desc("last_seq"), "session_id")
    cells = cells.withColumn("_r", F.row_number().over(latest)).filter("_r = 1").drop("_r")
    return cells.filter("session_id % 2 = 0"), cells.filter("session_id % 2 = 1")


_SURVEYS = """, side AS (SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY session_id % 2, rat, freq, phy ORDER BY last_seq DESC, session_id) = 1),
a AS (SELECT * FROM side WHERE session_id % 2 = 0), b AS (SELECT * FROM side WHERE session_id % 2 = 1)"""
_DIFF = f"""{_SURVEYS},
diff AS (SELECT coalesce(a.rat, b.rat) AS rat, coalesce(a.freq, b.freq) AS freq, coalesce(a.phy, b.phy) AS phy, a.cid AS our_cid, b.cid AS exp_cid,
  CASE WHEN a.rat IS NOT NULL AND b.rat IS NOT NULL THEN 'shared' WHEN a.rat IS NOT NULL THEN 'ours' ELSE 'expected' END AS side,
  CASE WHEN a.cid <> 0 AND b.cid <> 0 THEN CASE WHEN a.cid = b.cid THEN 'match' ELSE 'mismatch' END END AS cid_match, a.rsrp IS NOT NULL AND b.rsrp IS NOT NULL AS both_signal
  FROM a FULL JOIN b ON a.rat = b.rat AND a.freq = b.freq AND a.phy = b.phy)"""


def on_diff(name: str, body: str):
    return register(name, f"WITH {sql.REGISTRY}{_DIFF}\n{body}")


@register(
    "g3_fill_siblings",
    f"""WITH {sql.REGISTRY}, sib AS (
  SELECT rat, freq, phy, arg_min(mcc, row(first_seq, session_id)) FILTER (mcc IS NOT NULL) AS s_mcc, arg_min(tac, row(first_seq, session_id)) FILTER (tac IS NOT NULL) AS s_tac,
         arg_min(rsrp, row(first_seq, session_id)) FILTER (rsrp IS NOT NULL) AS s_rsrp, max(seen) AS s_seen
  FROM reg GROUP BY rat, freq, phy)
SELECT session_id, rat, freq, phy, coalesce(mcc, s_mcc) AS mcc, coalesce(tac, s_tac) AS tac, coalesce(rsrp, s_rsrp) AS rsrp, greatest(seen, s_seen) AS seen
FROM reg LEFT JOIN sib USING (rat, freq, phy) WHERE {sql.COMPLETE}""",
)
def _(spark, d):
    reg = registry_of(spark, d)
    return towers.fill_from_siblings(reg.filter(P.is_complete()), reg).select(*R.KEY, "mcc", "tac", "rsrp", "seen")


@on_diff("g4_diff_cells", "SELECT * FROM diff")
def _(spark, d):
    return towers.diff_cells(*_sides(spark, d))


@on_diff("g5_diff_samples", "(SELECT 'only_ours' AS kind, rat || '|' || freq || '|' || phy AS cell FROM diff WHERE side = 'ours' ORDER BY rat, freq, phy LIMIT 12) UNION ALL (SELECT 'only_expected', rat || '|' || freq || '|' || phy FROM diff WHERE side = 'expected' ORDER BY rat, freq, phy LIMIT 12) UNION ALL (SELECT 'cid_mismatch', rat || '|' || freq || '|' || phy FROM diff WHERE cid_match = 'mismatch' ORDER BY rat, freq, phy LIMIT 20)")
def _(spark, d):
    return towers.diff_samples(towers.diff_cells(*_sides(spark, d)))


@on_diff("h5_diff_summary", "SELECT *, CASE WHEN shared + only_expected = 0 THEN 0 ELSE 100 * shared // (shared + only_expected) END AS coverage FROM (SELECT coalesce(rat, 'TOTAL') AS rat, count(*) FILTER (WHERE side = 'shared') AS shared, count(*) FILTER (WHERE side = 'ours') AS only_ours, count(*) FILTER (WHERE side = 'expected') AS only_expected, count(*) FILTER (WHERE cid_match = 'match') AS cid_match, count(*) FILTER (WHERE cid_match = 'mismatch') AS cid_mismatch, count(*) FILTER (WHERE both_signal) AS both_signal FROM diff GROUP BY ROLLUP (rat))")
def _(spark, d):
    return towers.diff_summary(towers.diff_cells(*_sides(spark, d)))


@register(
    "g6_match_dumps",
    f"""WITH {sql.REGISTRY}{_SURVEYS}
SELECT rat, mcc, mnc, tac, cid, freq, phy, a.rsrp AS left_rsrp, b.rsrp AS right_rsrp, a.last_seq AS left_last, b.last_seq AS right_last
FROM a JOIN b USING (rat, mcc, mnc, tac, cid, freq, phy)""",
)
def _(spark, d):
    return towers.match_dumps(*_sides(spark, d))


def _external(spark, d):
    # Two in three identified LTE cells of all sessions: a reference table of the same cells.
    cells = registry_of(spark, d).filter("rat = 'LTE' and cid <> 0 and cid % 3 <> 0")
    return cells.select("mcc", "mnc", F.col("tac").alias("lac"), F.col("cid").alias("cellid"), (F.col("freq") * 0.5).alias("lat"), (F.col("phy") * 0.25).alias("lon"), F.col("mnc").alias("samples"), F.lit("LTE").alias("radio")).dropDuplicates(["mcc", "mnc", "lac", "cellid"])


_EXT = ", ext AS (SELECT DISTINCT mcc, mnc, tac, cid FROM reg WHERE rat = 'LTE' AND cid <> 0 AND cid % 3 <> 0)"
_STATUS = "CASE WHEN rat <> 'LTE' OR coalesce(mcc, 0) = 0 OR coalesce(tac, 0) = 0 OR coalesce(cid, 0) = 0 THEN 'skipped' WHEN e IS NOT NULL THEN 'found' ELSE 'missing' END"


@register("g7_enrich", f"WITH {sql.REGISTRY}{_EXT} SELECT session_id, rat, freq, phy, {_STATUS} AS status FROM reg LEFT JOIN (SELECT *, 1 AS e FROM ext) USING (mcc, mnc, tac, cid)")
def _(spark, d):
    return towers.enrich(registry_of(spark, d), _external(spark, d)).select(*R.KEY, "status")


@register(
    "g7_unmatched_sites",
    f"WITH {sql.REGISTRY}{_EXT} SELECT session_id, (cid // 256) % 1048576 AS enb, count(*) AS cells, count(*) FILTER (WHERE {_STATUS} = 'missing') AS missing, count(*) FILTER (WHERE {_STATUS} = 'missing') > 0 AS unmatched"
    " FROM reg LEFT JOIN (SELECT *, 1 AS e FROM ext) USING (mcc, mnc, tac, cid) WHERE rat = 'LTE' AND cid <> 0 GROUP BY 1, 2",
)
def _(spark, d):
    return towers.unmatched_sites(towers.enrich(registry_of(spark, d), _external(spark, d)))


_LABELS = (
    ("Radio", "rat", "CASE WHEN f THEN 'LTE' END"), ("MCC", "mcc", "CASE WHEN f THEN mcc END"), ("MNC", "mnc", "CASE WHEN f THEN mnc END"), ("TAC / LAC", "tac", "CASE WHEN f THEN tac END"), ("CID", "cid", "CASE WHEN f THEN cid END"),
    ("eNB", "(cid // 256) % 1048576", "NULL"), ("Sector (ncell)", "cid % 256", "NULL"), ("EARFCN", "freq", "NULL"), ("PCI", "phy", "NULL"), ("Band", "'B' || band", "NULL"), ("Duplex", "duplex", "NULL"),
    ("DL MHz", "round(dl + 0.1::DOUBLE * (freq - lo), 4)", "NULL"), ("UL MHz", "round(CASE duplex WHEN 'FDD' THEN ul ELSE dl END + 0.1::DOUBLE * (freq - lo), 4)", "NULL"), ("Bandwidth MHz", "bandwidth", "NULL"),
    ("RSRP", "rsrp", "NULL"), ("RSRQ", "rsrq", "NULL"), ("RSSI", "rssi", "NULL"), ("Samples", "NULL", "CASE WHEN f THEN mnc END"),
)


@register(
    "g8_labelled_diffs",
    f"WITH {sql.REGISTRY}{_EXT}, bands(band, duplex, lo, hi, dl, ul) AS (VALUES {_BANDS}),"
    f" l AS (SELECT r.*, b.*, {_STATUS} = 'found' AS f FROM reg r LEFT JOIN (SELECT *, 1 AS e FROM ext) USING (mcc, mnc, tac, cid) LEFT JOIN bands b ON r.freq BETWEEN lo AND hi WHERE rat = 'LTE'), x AS ("
    + " UNION ALL ".join(f"SELECT session_id, rat, freq, phy, '{k}' AS label, lower(coalesce(({a})::VARCHAR, '')) AS ours, lower(coalesce(({b})::VARCHAR, '')) AS ext FROM l" for k, a, b in _LABELS)
    + ") SELECT *, CASE WHEN ours = ext THEN 'Match' WHEN ext = '' THEN 'OursOnly' WHEN ours = '' THEN 'ExtOnly' ELSE 'Mismatch' END AS verdict, CASE WHEN ours <> '' THEN ours ELSE ext END AS merged FROM x WHERE ours <> '' OR ext <> ''",
)
def _(spark, d):
    """All labels but the two of the place, whose numbers are of another cell with the same identity."""
    return towers.labelled_diffs(towers.enrich(registry_of(spark, d), _external(spark, d))).filter("label not in ('Latitude', 'Longitude')")


@register(
    "g8_field_diffs",
    f"WITH {sql.REGISTRY}, x AS (SELECT session_id, rat, freq, phy, coalesce(tac::VARCHAR, '') AS ours, coalesce(CASE WHEN seen % 4 = 0 THEN NULL WHEN seen % 4 = 1 THEN seen ELSE tac END::VARCHAR, '') AS ext FROM reg)"
    " SELECT *, 'tac' AS label, CASE WHEN ours = ext THEN 'Match' WHEN ext = '' THEN 'OursOnly' WHEN ours = '' THEN 'ExtOnly' ELSE 'Mismatch' END AS verdict, CASE WHEN ours <> '' THEN ours ELSE ext END AS merged FROM x WHERE ours <> '' OR ext <> ''",
)
def _(spark, d):
    other = F.when(F.col("seen") % 4 == 0, F.lit(None)).when(F.col("seen") % 4 == 1, F.col("seen")).otherwise(F.col("tac"))
    padded = F.when(other.isNotNull(), F.concat(F.lit("00"), other.cast("string")))
    return towers.field_diffs(registry_of(spark, d).withColumn("ext_tac", padded), {"tac": ("tac", "ext_tac")})


@on_registry("g9_neighbour_edges", "SELECT DISTINCT t.session_id, least(a.cid, b.cid) AS a, greatest(a.cid, b.cid) AS b FROM told t JOIN reg a ON a.session_id = t.session_id AND a.rat = t.rat AND a.freq = t.freq AND a.phy = t.phy JOIN reg b ON b.session_id = t.session_id AND b.rat = t.rat AND b.freq = t.nb_freq AND b.phy = t.nb_phy WHERE a.cid <> 0 AND b.cid <> 0 AND a.cid <> b.cid")
def _(spark, d):
    return towers.neighbour_edges(*snapshot(spark, d))


@on_registry("g10_hierarchy_edges", "SELECT DISTINCT 'operator' AS kind, mcc || '-' || lpad(mnc::VARCHAR, 2, '0') AS parent, (cid // 256 % 1048576)::VARCHAR AS child FROM reg WHERE rat = 'LTE' AND cid <> 0 UNION SELECT 'site', (cid // 256 % 1048576)::VARCHAR, cid::VARCHAR FROM reg WHERE rat = 'LTE' AND cid <> 0")
def _(spark, d):
    return towers.hierarchy_edges(registry_of(spark, d))


@on_registry(
    "g11_place_incomplete",
    f"SELECT r.session_id, r.rat, r.freq, r.phy, coalesce(c.enb, s.enb) AS enb, CASE WHEN c.enb IS NOT NULL THEN 'carrier' WHEN s.enb IS NOT NULL THEN 'area' ELSE 'free' END AS placed_by FROM (SELECT * FROM reg WHERE rat = 'LTE' AND NOT ({sql.GHOST}) AND NOT coalesce({sql.FULL_LTE}, FALSE)) r"
    f" LEFT JOIN (SELECT session_id, freq, min(cid // 256) AS enb FROM reg WHERE {sql.FULL_LTE} GROUP BY ALL) c USING (session_id, freq)"
    f" LEFT JOIN (SELECT session_id, tac, min(enb) AS enb FROM (SELECT session_id, cid // 256 AS enb, arg_min(tac, (freq, phy)) AS tac FROM reg WHERE {sql.FULL_LTE} GROUP BY ALL) GROUP BY ALL) s USING (session_id, tac)",
)
def _(spark, d):
    return towers.place_incomplete(registry_of(spark, d))


@on_registry("g12_earfcn_peers", f"SELECT mcc, mnc, freq, string_agg(DISTINCT (cid // 256)::VARCHAR, ',' ORDER BY (cid // 256)::VARCHAR) AS sites FROM reg WHERE {sql.FULL_LTE} GROUP BY ALL")
def _(spark, d):
    return towers.earfcn_peers(registry_of(spark, d))


_ADVERTISED = """, served AS (SELECT session_id, freq, phy FROM reg WHERE rat = 'LTE' AND ever_serving),
adv AS (SELECT DISTINCT t.session_id, t.nb_freq AS freq, t.nb_phy AS phy FROM told t JOIN served s ON s.session_id = t.session_id AND s.freq = t.freq AND s.phy = t.phy
  WHERE t.nb_phy BETWEEN 1 AND 503 AND NOT (EXISTS (FROM served x WHERE x.session_id = t.session_id AND x.freq = t.nb_freq AND x.phy = t.nb_phy) AND (t.freq, t.phy) <= (t.nb_freq, t.nb_phy)))"""


@register("g13_serving_neigh_keys", f"WITH {sql.REGISTRY}{_ADVERTISED} SELECT * FROM adv")
def _(spark, d):
    return ranking.serving_neigh_keys(*snapshot(spark, d))


@register(
    "g14_pending_keys",
    f"WITH {sql.REGISTRY}{_ADVERTISED} (SELECT * FROM adv UNION SELECT session_id, freq, phy FROM reg r WHERE rat = 'LTE' AND NOT coalesce({sql.FULL_LTE}, FALSE) AND NOT ever_serving AND rsrp > -154 AND phy BETWEEN 1 AND 503"
    f" AND (session_id, freq) IN (SELECT (session_id, freq) FROM reg WHERE {sql.FULL_LTE})) EXCEPT SELECT * FROM served",
)
def _(spark, d):
    return ranking.pending_keys(*snapshot(spark, d))


@register(
    "g15_bare_carriers",
    f"WITH {sql.REGISTRY}{_ADVERTISED} SELECT t.session_id, t.nb_freq AS freq, t.nb_freq < 36000 AND t.nb_freq <> 32768 AS fdd FROM lists t"
    " JOIN served s ON s.session_id = t.session_id AND s.freq = t.freq AND s.phy = t.phy WHERE t.rat = 'LTE' AND t.source <> 'utra' AND t.nb_freq <> t.freq"
    " AND NOT EXISTS (FROM reg r WHERE r.rat = 'LTE' AND r.phy <> 0 AND r.session_id = t.session_id AND r.freq = t.nb_freq) GROUP BY ALL HAVING count(*) FILTER (WHERE t.nb_phy > 0) = 0",
)
def _(spark, d):
    told = _lists(spark, d).filter("rat = 'LTE' and phy <> 0 and source <> 'utra'")
    return ranking.bare_carriers(registry_of(spark, d), told)


# ---- I: dedup, windows, top-k ------------------------------------------------------------------

_WIN = "ORDER BY last_seq DESC NULLS LAST, seen DESC NULLS LAST, session_id, freq, phy"


@on_registry("i1_unique_complete", f"SELECT session_id, rat, freq, phy, cid, last_seq FROM (SELECT *, row_number() OVER (PARTITION BY rat, cid {_WIN}) AS rn FROM reg WHERE {sql.COMPLETE}) WHERE rn = 1")
def _(spark, d):
    return towers.unique_complete(registry_of(spark, d), scope=[]).select(*R.KEY, "cid", "last_seq")


@on_registry("i2_unique_rf", f"SELECT session_id, rat, freq, phy, seen FROM (SELECT *, row_number() OVER (PARTITION BY rat, freq, phy {_WIN}) AS rn FROM reg WHERE freq <> 0) WHERE rn = 1")
def _(spark, d):
    return towers.unique_rf(registry_of(spark, d), scope=[]).select(*R.KEY, "seen")


@on_registry("i3_latest_rows", "SELECT session_id, rat, freq, phy FROM (SELECT *, row_number() OVER (PARTITION BY rat, freq, phy ORDER BY last_seq DESC, first_seq DESC) AS rn FROM reg WHERE last_seq IS NOT NULL) WHERE rn = 1")
def _(spark, d):
    return towers.latest_rows(registry_of(spark, d).filter("last_seq is not null"), True, "first_seq").select(*R.KEY)


@on_registry("i4_top_per_rat", "SELECT session_id, rat, freq, phy, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY rat ORDER BY last_seq DESC NULLS LAST, session_id, freq, phy) AS place FROM reg) WHERE place <= 25")
def _(spark, d):
    return towers.top_per_rat(registry_of(spark, d), 25).select(*R.KEY, "place")


_FDD = f"coalesce(({sql.BAND}) < 33, FALSE)"
_BANDED = f"phy BETWEEN 1 AND 503 AND ({sql.BAND}) IS NOT NULL"


@register("i5_rank_gaps", f"""WITH {sql.REGISTRY}, x AS (
  SELECT session_id, freq, phy, coalesce(rsrp, -160) AS rsrp FROM reg WHERE rat = 'LTE' AND NOT coalesce({sql.FULL_LTE}, FALSE)
  UNION ALL SELECT session_id, nb_freq, nb_phy, -155 FROM told WHERE source = 'inter'),
y AS (SELECT session_id, freq, phy, max(rsrp) AS rsrp FROM x WHERE {_BANDED} GROUP BY ALL),
z AS (SELECT y.*, coalesce(full_on_earfcn, 0) AS n FROM y LEFT JOIN frontier USING (session_id, freq) WHERE NOT EXISTS (FROM reg WHERE {sql.FULL_LTE} AND reg.session_id = y.session_id AND reg.freq = y.freq AND reg.phy = y.phy)),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_FDD} DESC, rsrp > -154 DESC, n, rsrp DESC, freq, phy) AS place FROM z)
SELECT session_id, freq, phy, rsrp::DOUBLE AS rsrp, place::INT AS place FROM r WHERE place <= 16""")
def _(spark, d):
    return ranking.rank_gaps(*snapshot(spark, d))


_WALK = f""", own AS (SELECT session_id, freq, phy, coalesce(rsrp, -160) AS rsrp, coalesce({sql.FULL_LTE}, FALSE) AS f, mcc, mnc, ever_serving AS camped FROM reg WHERE rat = 'LTE'
  UNION ALL SELECT session_id, nb_freq, nb_phy, -155, FALSE, NULL, NULL, FALSE FROM told WHERE source IN ('meas', 'inter')),
tg AS (SELECT session_id, freq, phy, max(rsrp)::DOUBLE AS rsrp, bool_or(f) AS has_full, bool_or(camped) AS camped, arg_max(mcc, (f, rsrp)) FILTER (WHERE mcc <> 0) AS mcc, arg_max(mnc, (f, rsrp)) FILTER (WHERE mcc <> 0) AS mnc FROM own WHERE {_BANDED} GROUP BY ALL)"""
_CAMPS = "greatest(coalesce(c.plmn_camps, 0), coalesce(max_plmn_camps, 0)) AS camps, coalesce(full_on_earfcn, 0) AS n FROM {} t LEFT JOIN frontier USING (session_id, freq) LEFT JOIN camps c USING (session_id, mcc, mnc)"
_GENERAL = f"{_FDD} DESC, n > 0, camps, rsrp > -154 DESC, n, has_full, rsrp DESC, freq, phy"


@register("i6_rank_full_walk", f"WITH {sql.REGISTRY}{_WALK}, z AS (SELECT t.*, {_CAMPS.format('tg')} WHERE NOT camped), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_GENERAL}) AS place FROM z) SELECT session_id, freq, phy, rsrp, has_full, place::INT AS place FROM r WHERE place <= 16")
def _(spark, d):
    return ranking.rank_full_walk(*snapshot(spark, d))


_SEEDS = f", sd AS (SELECT session_id, freq, phy, coalesce(rsrp, -160)::DOUBLE AS rsrp, coalesce({sql.FULL_LTE}, FALSE) AS has_full, ever_serving AS camped, mcc, mnc FROM reg WHERE rat = 'LTE' AND {_BANDED})"


@register("i7_rank_seeds", f"WITH {sql.REGISTRY}{_SEEDS}, z AS (SELECT t.*, {_CAMPS.format('sd')} WHERE NOT camped), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY has_full DESC, {_GENERAL}) AS place FROM z WHERE has_full OR rsrp > -154 OR n = 0) SELECT session_id, freq, phy, rsrp, has_full, place::INT AS place FROM r WHERE place <= 16")
def _(spark, d):
    return ranking.rank_seeds(registry_of(spark, d), full_walk=True)


@register(
    "i8_rank_allowed",
    f"WITH {sql.REGISTRY}, al AS (SELECT DISTINCT session_id, nb_freq AS freq, nb_phy AS phy FROM told WHERE nb_phy % 5 = 0), t AS (SELECT a.*, coalesce(r.rsrp, -160)::DOUBLE AS rsrp, coalesce(f, FALSE) AS has_full, mcc, mnc FROM al a LEFT JOIN (SELECT *, coalesce({sql.FULL_LTE}, FALSE) AS f FROM reg WHERE rat = 'LTE') r USING (session_id, freq, phy) WHERE ({sql.BAND.replace('freq', 'a.freq')}) IS NOT NULL),"
    f" z AS (SELECT t.*, {_CAMPS.format('t')}), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_FDD} DESC, rsrp > -154 DESC, n, rsrp DESC, freq, phy) AS place FROM z) SELECT session_id, freq, phy, rsrp, place::INT AS place FROM r WHERE place <= 16",
)
def _(spark, d):
    reg, told = snapshot(spark, d)
    keys = told.filter("nb_phy % 5 = 0").select("session_id", F.col("nb_freq").alias("freq"), F.col("nb_phy").alias("phy"))
    return ranking.rank_allowed(reg, keys)


@register(
    "i9_rank_wcdma",
    f"""WITH {sql.REGISTRY},
c AS (SELECT session_id, mcc, mnc, count(*) AS k FROM reg WHERE rat = 'WCDMA' AND ever_serving AND mcc <> 0 GROUP BY ALL),
x AS (SELECT session_id, freq, phy, CASE WHEN coalesce(rscp, rsrp) > -120 AND coalesce(rscp, rsrp) < 0 THEN coalesce(rscp, rsrp) ELSE -160 END AS level, mcc, mnc, coalesce({sql.FULL_WCDMA}, FALSE) AS f
    FROM reg WHERE rat = 'WCDMA' AND (NOT ever_serving OR phy = 0)
  UNION ALL SELECT l.session_id, nb_freq, CASE source WHEN 'utra' THEN 0 ELSE nb_phy END, CASE source WHEN 'utra' THEN -158 ELSE coalesce(m_rscp, -155) END, mcc, mnc, FALSE
    FROM lists l LEFT JOIN reg r ON r.session_id = l.session_id AND r.rat = l.rat AND r.freq = l.freq AND r.phy = l.phy WHERE source IN ('wcdma', 'utra')),
z AS (SELECT session_id, freq, phy, max(level)::DOUBLE AS rsrp, bool_or(f) AS f, max((f, level, mcc, mnc)) FILTER (WHERE mcc <> 0) AS p FROM x WHERE freq BETWEEN 1 AND 16383 AND phy BETWEEN 0 AND 511 GROUP BY ALL),
y AS (SELECT z.session_id, freq, phy, rsrp, f, coalesce(k, 0) AS k FROM z LEFT JOIN c ON c.session_id = z.session_id AND c.mcc = p[3] AND c.mnc = p[4])
SELECT session_id, freq, phy, rsrp, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY phy > 0 DESC, k, f, rsrp DESC, freq, phy) AS place FROM y) WHERE place <= 16""",
)
def _(spark, d):
    return ranking.rank_wcdma(registry_of(spark, d), _lists(spark, d))


@on_registry("i10_order_by_signal", "SELECT session_id, rat, freq, phy, is_serving, rsrp FROM reg")
def _(spark, d):
    return towers.order_by_signal(registry_of(spark, d)).select(*R.KEY, "is_serving", "rsrp")


@register("i11_sample_packets", f"WITH {sql.OBS}, {_PACKETS} SELECT log_code, seq, place::INT AS place, total, 3::INT AS bytes, lpad(upper(printf('%x', seq % 256)), 2, '0') AS version FROM (SELECT log_code, seq, row_number() OVER (PARTITION BY log_code ORDER BY seq) AS place, count(*) OVER (PARTITION BY log_code) AS total FROM pk) WHERE place <= 12")
def _(spark, d):
    packets = _packets(spark, d).withColumn("payload", F.unhex(F.concat(F.lpad(F.hex(F.col("seq") % 256), 2, "0"), F.lit("0102"))))
    return ranking.sample_packets(packets, None)


@on_registry("k3_changed_cells", "SELECT session_id, rat, freq, phy, CASE WHEN o.rat IS NULL THEN 'new' ELSE 'changed' END AS change FROM reg LEFT JOIN (SELECT session_id, rat, freq, phy, cid AS ocid FROM reg WHERE phy % 3 <> 0) o USING (session_id, rat, freq, phy) WHERE phy % 3 = 0")
def _(spark, d):
    reg = registry_of(spark, d)
    return ranking.changed_cells(reg.filter("phy % 3 <> 0"), reg).select(*R.KEY, "change")


@register(
    "k6_vote_packing",
    f"WITH {sql.OBS}, x AS (SELECT session_id, seq, ((seq * 37 + phy) % 65536)::INT AS w FROM obs), y AS (SELECT *, w % 512 AS lo, (w // 128) % 512 AS hi FROM x),"
    " z AS (SELECT *, CASE WHEN hi BETWEEN 1 AND 503 AND NOT lo BETWEEN 1 AND 503 THEN 'MSB' WHEN lo BETWEEN 1 AND 503 AND NOT hi BETWEEN 1 AND 503 THEN 'LSB' WHEN lo BETWEEN 1 AND 503 AND hi BETWEEN 1 AND 503 AND w % 128 > 7 THEN 'LSB' END AS own FROM y),"
    " v AS (SELECT *, count(*) FILTER (WHERE own = 'LSB') OVER p AS l, count(*) FILTER (WHERE own = 'MSB') OVER p AS m FROM z WINDOW p AS (PARTITION BY session_id ORDER BY seq)),"
    " k AS (SELECT *, first_value(CASE WHEN own = 'LSB' AND l >= 3 AND l > m THEN 'LSB' WHEN own = 'MSB' AND m >= 3 AND m > l THEN 'MSB' END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS locked FROM v),"
    " f AS (SELECT *, coalesce(own, locked, CASE WHEN lo BETWEEN 1 AND 503 THEN 'LSB' ELSE 'MSB' END) AS pack FROM k)"
    " SELECT session_id, seq, w AS word, locked, CASE pack WHEN 'LSB' THEN lo ELSE hi END AS pci, CASE pack WHEN 'LSB' THEN (w // 512) % 8 ELSE w % 8 END AS prio, pack FROM f",
)
def _(spark, d):
    return ranking.vote_packing(observations(spark, d).select("session_id", "seq", ((F.col("seq") * 37 + F.col("phy")) % 65536).cast("int").alias("word")))

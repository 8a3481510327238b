"""Queries over modem text, files, packets and streams, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import decode, modem_text
from ..operators import registry as R
from ..operators.durable import durable
from ..sources import files
from ..streaming import live
from . import sql
from .catalog import _lists, observations, register, registry_of
from .catalog_packets import le_hex


def _folder(spark, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        durable(spark.range(1), "probe")  # sets a private folder where none is named
        base = spark.conf.get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _replies(df: DataFrame, reply) -> DataFrame:
    return df.select("session_id", "seq", reply.alias("reply"))


def _text(fmt: str, *columns):
    return F.format_string(fmt, *columns)


# ---- T: modem text -----------------------------------------------------------------------------

_SERVED = "rat = 'LTE' AND cid IS NOT NULL AND tac IS NOT NULL"


def _cmgrmi(spark, d) -> DataFrame:
    lte = observations(spark, d).filter(_SERVED)
    level = (-400 - F.col("seq") % 1100).cast("int")
    inter = F.when(F.col("nb_source") == "inter", _text("\r\n+CMGRMI: LTE_Inter,1,Freq1,%d,2,0,0,0\r\n+CMGRMI: LTE_InterFreq1_Cell1,%d,-100,-946,-756,0", "nb_freq", "nb_phy"))
    intra = _text("\r\n+CMGRMI: LTE_Intra_Cell1,%d,-112,-914,-599,0", "nb_phy")
    head = _text("+CMGRMI: Main_Info,4,1\r\n+CMGRMI: Serving_Cell,%d,%d,%02d,%d,%d,%d,1,4,4,17,%d,-112,%d,-599,0", "freq", "mcc", "mnc", "tac", (F.col("seq") % 2000).cast("int"), "cid", "phy", level)
    return _replies(lte, F.concat(head, F.coalesce(inter, intra, F.lit("")), F.lit("\r\nOK")))


_CELLS = f"""WITH {sql.OBS}, l AS (SELECT * FROM obs WHERE {_SERVED}), s AS (SELECT *, phy BETWEEN 1 AND 503 AS ok FROM l),
cells AS (
  SELECT session_id, seq, 'serving' AS kind, freq AS earfcn, phy AS pci, mcc, mnc, tac, CASE WHEN seq % 2000 BETWEEN 1 AND 1282 THEN (seq % 2000)::INT END AS ta, cid, 15 AS dl_bw, -112 / 10 AS rsrq, (-400 - seq % 1100) / 10 AS rsrp FROM s WHERE ok
  UNION ALL
  SELECT session_id, seq, 'neighbour', nb_freq, nb_phy, NULL, NULL, NULL, NULL, NULL, NULL, CASE nb_source WHEN 'inter' THEN -100 / 10 ELSE -112 / 10 END, CASE nb_source WHEN 'inter' THEN -946 / 10 ELSE -914 / 10 END
  FROM s WHERE nb_phy BETWEEN 1 AND 503 AND (ok OR nb_source = 'inter'))"""


@register("t1_cmgrmi", f"{_CELLS} SELECT * FROM cells")
def _(spark, d):
    return modem_text.parse_cmgrmi(_cmgrmi(spark, d)).select("session_id", "seq", "kind", "earfcn", "pci", "mcc", "mnc", "tac", "ta", "cid", "dl_bw", "rsrq", "rsrp")


@register("t2_cmgrmi_events", f"{_CELLS} SELECT session_id, seq, earfcn AS freq, pci AS phy, e AS kind, CASE e WHEN 'passport' THEN cid END AS cid, CASE e WHEN 'signal' THEN rsrp END AS rsrp FROM (SELECT *, unnest(CASE kind WHEN 'serving' THEN ['radio', 'passport', 'signal', 'serving'] ELSE ['radio', 'signal'] END) AS e FROM cells)")
def _(spark, d):
    return modem_text.cmgrmi_events(modem_text.parse_cmgrmi(_cmgrmi(spark, d))).select("session_id", "seq", "freq", "phy", "kind", "cid", "rsrp")


def _cpsi(spark, d) -> DataFrame:
    obs = observations(spark, d).filter("rat in ('LTE', 'WCDMA') AND cid IS NOT NULL AND tac IS NOT NULL")
    lte = _text("+CPSI: LTE,Online,250-%02d,0x%X,%d,%d,EUTRAN-BAND7,%d,3,3,-69,-900,-661,20", "mnc", "tac", "cid", "phy", "freq")
    wcdma = _text("+CPSI: WCDMA,Online,250-%02d,0x%X,%d,WCDMA IMT 2000,%d,%d,0,4.0,%d,32,46,500", "mnc", "tac", "cid", "phy", "freq", (F.col("seq") % 121).cast("int"))
    noise = F.lit("+CPSI: LTE,Online,250-20,0x1234,1234567,0,EUTRAN-BAND0,4294967295,3,3,-69,-900,-661,20\r\n")
    return _replies(obs, F.concat(noise, F.when(F.col("rat") == "LTE", lte).otherwise(wcdma), F.lit("\r\n+CPSI: NO SERVICE,Online\r\nOK")))


@register("t3_cpsi", f"WITH {sql.OBS} SELECT session_id, seq, rat, mcc, mnc, tac, cid, freq, phy, CASE rat WHEN 'LTE' THEN -90.0::DOUBLE ELSE (seq % 121 - 116)::DOUBLE END AS level FROM obs WHERE cid IS NOT NULL AND tac IS NOT NULL AND (rat = 'LTE' AND phy BETWEEN 1 AND 503 OR rat = 'WCDMA')")
def _(spark, d):
    return modem_text.parse_cpsi(_cpsi(spark, d)).select("session_id", "seq", "rat", "mcc", "mnc", "tac", "cid", "freq", "phy", "level")


@register("t4_cereg", f"WITH {sql.OBS} SELECT session_id, seq, tac, cid FROM obs WHERE cid IS NOT NULL AND tac IS NOT NULL")
def _(spark, d):
    obs = observations(spark, d).select("session_id", "seq", F.coalesce("tac", F.lit(0)).alias("tac"), F.coalesce("cid", F.lit(0)).alias("cid"))
    return modem_text.parse_cereg(_replies(obs, _text('+CEREG: 2,1,"%X","%X",7\r\nOK', "tac", "cid")))


@register("t4_cnwinfo", f"WITH {sql.OBS} SELECT session_id, seq, mcc, mnc, cid FROM obs WHERE {_SERVED}")
def _(spark, d):
    obs = observations(spark, d).filter(_SERVED)
    return modem_text.parse_cnwinfo(_replies(obs, _text("+CNWINFO: LTE,%d%02d%d,17\r\nOK", "mcc", "mnc", "cid")))


@register("t5_cops", f"WITH {sql.OBS} SELECT session_id, seq, mcc, mnc FROM obs")
def _(spark, d):
    return modem_text.parse_cops(_replies(observations(spark, d), _text('+COPS: 0,2,"%d%02d",7\r\nOK', "mcc", "mnc")))


@register("t5_cops_list", f"WITH {sql.OBS} SELECT session_id, seq, CASE mnc WHEN 1 THEN '250-01' WHEN 2 THEN '250-01,250-02' ELSE '250-01,250-' || mnc END AS plmns FROM obs")
def _(spark, d):
    return modem_text.parse_cops_list(_replies(observations(spark, d), _text('+COPS: (2,"x","y","%d%02d",7),(1,"A","B","250-01",2),(1,"12")\r\nOK', "mcc", "mnc")))


@register("t6_observed_rat", f"WITH {sql.OBS} SELECT session_id, seq, CASE WHEN rat = 'LTE' OR rat = 'WCDMA' THEN rat WHEN rat = 'NR' THEN 'NR' WHEN j % 2 = 0 THEN 'GSM' ELSE 'NO_SERVICE' END AS observed FROM obs")
def _(spark, d):
    line = F.when(F.col("rat") == "LTE", "+CPSI: LTE,Limited").when(F.col("rat") == "WCDMA", "+CPSI: WCDMA,Online,250-20,0x1234,7654321,B,38,10563,0,4.0,69").when(F.col("rat") == "NR", "+CPSI: NR5G_SA,Online").when(F.col("j") % 2 == 0, "+CPSI: GSM,Online").otherwise("+CPSI: NO SERVICE,Online")
    return modem_text.observed_rat(_replies(observations(spark, d), line))


_QMI = "q AS (SELECT session_id, seq, (seq // 50)::INT AS round, rat, freq AS rf_channel, phy AS phy_id, cid AS cell_id, kind = 'serving' AS serving FROM obs)"


def _qmi(spark, d) -> DataFrame:
    return observations(spark, d).select("session_id", "seq", F.floor(F.col("seq") / 50).cast("int").alias("round"), "rat", F.col("freq").alias("rf_channel"), F.col("phy").alias("phy_id"), F.col("cid").alias("cell_id"), (F.col("kind") == "serving").alias("serving"))


@register("t7_qmi_events", f"WITH {sql.OBS}, {_QMI} SELECT s.session_id, s.round, s.rf_channel AS freq, s.phy_id AS phy, CASE WHEN o.rf_channel = s.rf_channel THEN 'meas' ELSE 'inter' END AS source, o.rf_channel AS nb_freq, array_to_string(list_sort(list_distinct(list(o.phy_id))), ',') AS pcis FROM q s JOIN q o USING (session_id, round) WHERE s.rat = 'LTE' AND s.serving AND o.rat = 'LTE' AND NOT o.serving GROUP BY ALL")
def _(spark, d):
    return modem_text.qmi_events(_qmi(spark, d)).withColumn("pcis", F.array_join("pcis", ","))


@register("t8_merge_rounds", f"WITH {sql.OBS}, {_QMI} SELECT session_id, rat || '|' || rf_channel || '|' || phy_id || '|' || coalesce(cell_id::VARCHAR, '-') AS obs_key, min(round) AS round, min(seq) AS seq FROM q GROUP BY ALL")
def _(spark, d):
    return modem_text.merge_rounds(_qmi(spark, d)).select("session_id", "obs_key", "round", "seq")


# ---- A: files ----------------------------------------------------------------------------------


@register("a1_read_journal", f"WITH {sql.OBS} SELECT row_number() OVER (PARTITION BY session_id ORDER BY seq) AS seq, seq AS n, (45056 + i)::INT AS log_code, freq AS hdr_earfcn, phy AS hdr_pci, 'AA' || lpad(upper(printf('%x', seq % 65536)), 4, '0') AS payload FROM obs WHERE rat = 'LTE' AND seq % 7 <> 0")
def _(spark, d):
    """Journals are written, one file per session, with broken lines among them; what is read must be the rest."""
    path = _folder(spark, "journal")
    lte = observations(spark, d).filter("rat = 'LTE'").withColumn("hex", F.lpad(F.hex(F.col("seq") % 65536), 4, "0"))
    head = _text("[2026-07-29 16:56:36] rx 0x%04X earfcn=%d pci=%d pdu=%d", F.col("i") + 0xB000, "freq", "phy", F.col("seq").cast("int"))
    line = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("# note\n"), head, F.lit("\n    RAW: zz"))).otherwise(F.concat(head, F.lit("\n\n    RAW: AA "), F.substring("hex", 1, 2), F.lit(" "), F.substring("hex", 3, 2)))
    lte.select("session_id", "seq", line.alias("value")).repartition(5, "session_id").sortWithinPartitions("session_id", "seq").select("session_id", "value").write.partitionBy("session_id").text(path)
    packets, _errors = files.read_journal(spark, f"{path}/*")
    return packets.select("seq", F.col("hdr_pdu").cast("long").alias("n"), "log_code", "hdr_earfcn", "hdr_pci", F.hex("payload").alias("payload"))


_CSV = f"SELECT rat, freq AS arfcn, CASE WHEN rat <> 'GSM' THEN phy END AS pci, CASE WHEN rat = 'GSM' THEN phy END AS bsic, mcc, CASE WHEN mcc <> 0 THEN mnc END AS mnc, tac AS lac, cid, trunc(coalesce(rsrp, rscp, rxlev)) AS signal_dbm, is_serving::INT AS serving, seen::INT AS seen FROM reg"


@register("a2_read_cells_csv", f"WITH {sql.REGISTRY} {_CSV}")
def _(spark, d):
    path = _folder(spark, "cells")
    files.write_cells_csv(registry_of(spark, d), path)
    return files.read_cells_csv(spark, path).select("rat", "arfcn", "pci", "bsic", "mcc", "mnc", "lac", "cid", "signal_dbm", "serving", "seen")


@register("a3_read_towers_json", f"WITH {sql.REGISTRY} SELECT rat, rat || '|' || freq || '|' || phy AS key, CASE WHEN is_serving THEN '1' ELSE '0' END AS serving, CASE WHEN mcc IS NULL THEN '' ELSE mcc || '-' || lpad(mnc::VARCHAR, 2, '0') END AS mcc_mnc, coalesce(cid::VARCHAR, '') AS cid, coalesce(tac::VARCHAR, '') AS lac_or_tac, freq::VARCHAR AS channel, phy::VARCHAR AS code FROM reg")
def _(spark, d):
    """A document for each session and carrier, one a line, written as JSON text and read back."""
    path = _folder(spark, "document")
    rows = files.tower_rows(registry_of(spark, d))
    groups = [F.coalesce(F.collect_list(F.when(F.col("rat") == r, F.col("tower"))), F.array()).alias(r.lower()) for r in ("GSM", "LTE", "WCDMA", "NR")]
    rows.groupBy("session_id", "rat", S.channel("tower.radio").alias("carrier")).agg(F.struct(*groups).alias("towers")).select(F.to_json(F.struct("towers")).alias("value")).write.text(path)
    return files.read_towers_json(spark, path, one_a_line=True).select("rat", "key", "serving", "mcc_mnc", "cid", "lac_or_tac", "channel", "code")


@register("a4_scanner_log", f"WITH {sql.OBS} SELECT seq, CASE WHEN seq % 5 = 0 THEN '' ELSE '16:56:36' END AS time, CASE WHEN seq % 5 = 0 THEN '#' ELSE kind END AS tag, CASE WHEN seq % 5 = 0 THEN '# note ' || seq ELSE 'cell ' || freq END AS message FROM obs")
def _(spark, d):
    line = F.when(F.col("seq") % 5 == 0, _text("# note %d", "seq")).otherwise(_text("2026-07-29 16:56:36  %s cell %d", "kind", "freq"))
    return files.parse_scanner_log(observations(spark, d).select("seq", line.alias("line"))).drop("line")


_A5 = f"""WITH {sql.REGISTRY},
t AS (SELECT session_id, rat, freq, phy, CASE WHEN source IN ('wcdma', 'utra') THEN 'u' ELSE 'l' END AS g, nb_freq, nb_phy, coalesce(m_rsrp, m_rscp) AS level FROM lists WHERE source <> 'inter'),
n AS (SELECT session_id, rat, freq, phy, count(*) FILTER (WHERE g = 'l') AS nl, count(*) FILTER (WHERE g = 'u') AS nu,
    string_agg(nb_phy || coalesce(':' || trunc(level)::INT, ''), ';' ORDER BY nb_freq, nb_phy) FILTER (WHERE g = 'l') AS l,
    string_agg(nb_freq || coalesce('/' || nb_phy, '') || coalesce(':' || trunc(level)::INT, ''), ';' ORDER BY nb_freq, nb_phy NULLS FIRST) FILTER (WHERE g = 'u') AS u FROM t GROUP BY ALL)
SELECT r.rat, r.freq AS arfcn, CASE WHEN r.rat <> 'GSM' THEN r.phy END AS pci, CASE WHEN r.rat = 'GSM' THEN r.phy END AS bsic, mcc, mnc, nullif(tac, 0) AS lac, nullif(cid, 0) AS cid, trunc(coalesce(rsrp, rscp, rxlev)) AS signal_dbm, rsrq, snr,
  is_serving::INT AS serving, seen::INT AS seen, bandwidth, ul_freq AS ul_arfcn, nullif(nl, 0)::INT AS nb_lte, nullif(nu, 0)::INT AS nb_umts, l AS nb_lte_detail, u AS nb_umts_detail
FROM reg r LEFT JOIN n ON n.session_id = r.session_id AND n.rat = r.rat AND n.freq = r.freq AND n.phy = r.phy"""


@register("a5_write_cells_csv", _A5)
def _(spark, d):
    path = _folder(spark, "cells")
    files.write_cells_csv(registry_of(spark, d), path, _lists(spark, d))
    back = files.read_cells_csv(spark, path)
    return back.select("rat", "arfcn", "pci", "bsic", "mcc", "mnc", "lac", "cid", "signal_dbm", "rsrq", "snr", "serving", "seen", "bandwidth", "ul_arfcn", "nb_lte", "nb_umts", "nb_lte_detail", "nb_umts_detail")


def _documents(spark, d, mode: str) -> str:
    path = _folder(spark, "towers")
    files.write_towers_json(registry_of(spark, d), path, _lists(spark, d), mode)
    return path


_TOWER = "rat, rat || '|' || freq || '|' || phy AS key, CASE WHEN mcc IS NULL THEN '' ELSE mcc || '-' || lpad(mnc::VARCHAR, 2, '0') END AS mcc_mnc, coalesce(cid::VARCHAR, '') AS cid, freq::VARCHAR AS channel, phy::VARCHAR AS code, coalesce(coalesce(rsrp, rscp, rxlev)::VARCHAR, '') AS rxl"


@register("a6_write_towers_json", f"WITH {sql.REGISTRY.rstrip().rstrip(',')} SELECT {_TOWER} FROM reg WHERE freq <> 0")
def _(spark, d):
    """Survey documents, written and read back."""
    return files.read_towers_json(spark, _documents(spark, d, "survey"), one_a_line=True).select("rat", "key", "mcc_mnc", "cid", "channel", "code", "rxl")


@register(
    "a6_tower_neighbours",
    f"""WITH {sql.REGISTRY},
e AS (SELECT session_id, rat, freq, phy, nb_freq, nb_phy, source, m_rsrp, m_rscp FROM lists WHERE NOT coalesce(nb_freq = freq AND nb_phy = phy, FALSE)
  UNION ALL SELECT DISTINCT session_id, rat, freq, phy, nb_freq, NULL::INT, 'inter', NULL::DOUBLE, NULL::DOUBLE FROM lists l WHERE source = 'inter' AND nb_phy IS NOT NULL
    AND NOT EXISTS (FROM lists k WHERE k.session_id = l.session_id AND k.rat = l.rat AND k.freq = l.freq AND k.phy = l.phy AND k.nb_freq = l.nb_freq AND k.nb_phy IS NULL AND k.source = 'inter'))
SELECT e.rat || '|' || e.freq || '|' || e.phy AS key, CASE WHEN source IN ('wcdma', 'utra') THEN 'nb_umts' ELSE 'nb_lte' END AS nb_group, CASE WHEN source IN ('wcdma', 'utra') THEN 'WCDMA' ELSE 'LTE' END AS nb_rat,
  CASE WHEN r.rat IS NULL THEN '0' ELSE '1' END AS resolved, e.nb_freq::VARCHAR AS channel, coalesce(e.nb_phy::VARCHAR, '') AS code, coalesce(r.cid::VARCHAR, '') AS cid, coalesce(coalesce(m_rsrp, r.rsrp, m_rscp)::VARCHAR, '') AS rxl
FROM e JOIN reg t ON t.session_id = e.session_id AND t.rat = e.rat AND t.freq = e.freq AND t.phy = e.phy
LEFT JOIN reg r ON r.session_id = e.session_id AND r.rat = e.rat AND r.freq = e.nb_freq AND r.phy = e.nb_phy""",
)
def _(spark, d):
    return files.read_tower_neighbours(spark, _documents(spark, d, "survey"), one_a_line=True).drop("pos")


@register("a6_complete_towers", f"WITH {sql.REGISTRY.rstrip().rstrip(',')} SELECT rat || '|' || freq || '|' || phy AS key FROM (SELECT *, row_number() OVER (PARTITION BY session_id, rat, cid ORDER BY last_seq DESC NULLS LAST, phy <> 0 DESC, seen DESC NULLS LAST, freq, phy) AS rn FROM reg WHERE {sql.COMPLETE}) WHERE rn = 1")
def _(spark, d):
    return files.read_towers_json(spark, _documents(spark, d, "complete"), one_a_line=True).select("key")


# ---- C: packets --------------------------------------------------------------------------------


def _identity_packets(spark, d) -> DataFrame:
    obs = observations(spark, d).filter("rat = 'LTE'")
    n = lambda c, size: le_hex(F.coalesce(F.col(c), F.lit(0)), size)
    body = F.concat(F.lit("03"), n("phy", 2), n("freq", 4), le_hex(F.col("freq") + 18000, 4), F.lit("4B4B"), n("cid", 4), n("tac", 2), le_hex(F.lit(7), 4), n("mcc", 2), F.lit("02"), n("mnc", 2), F.lit("00"))
    return obs.select("session_id", "seq", F.lit(0xB0C2).alias("log_code"), F.unhex(body).alias("payload"))


@register("c4_decode_packets", f"WITH {sql.OBS} SELECT session_id, seq, k AS kind, freq::BIGINT AS freq, phy::BIGINT AS phy, CASE k WHEN 'passport' THEN cid END AS cid, CASE k WHEN 'passport' THEN mnc::BIGINT END AS mnc FROM (SELECT *, unnest(CASE WHEN cid IS NOT NULL AND tac IS NOT NULL THEN ['radio', 'passport'] ELSE ['radio'] END) AS k FROM obs WHERE rat = 'LTE' AND phy <= 503)")
def _(spark, d):
    return decode.decode_packets(_identity_packets(spark, d)).select("session_id", "seq", "kind", "freq", "phy", "cid", "mnc")


@register("c5_measurements", f"WITH {sql.OBS} SELECT session_id, seq, freq::BIGINT AS freq, (phy % 504)::BIGINT AS phy, (2000 - seq % 1500) / 16 - 180 AS rsrp FROM obs WHERE rat = 'LTE' AND (2000 - seq % 1500) / 16 - 180 BETWEEN -150 AND -40 AND phy % 504 <> 0")
def _(spark, d):
    obs = observations(spark, d).filter("rat = 'LTE' and phy % 504 <> 0")
    body = F.concat(F.lit("05000000"), le_hex(F.col("freq"), 4), le_hex(F.col("phy") % 504, 2), F.lit("0000"), le_hex(2000 - F.col("seq") % 1500, 4), F.lit("00" * 20))
    packets = obs.select("session_id", "seq", F.lit(0xB17F).alias("log_code"), F.unhex(body).alias("payload"))
    return decode.decode_packets(packets).filter("kind = 'signal'").select("session_id", "seq", "freq", "phy", "rsrp")


@register("c6_timing", f"WITH {sql.OBS} SELECT session_id, seq, seq % 1500 AS ta FROM obs WHERE rat = 'LTE' AND seq % 1500 <= 1282")
def _(spark, d):
    body = F.concat(F.lit("A101"), le_hex(F.col("seq") % 1500 * 2, 2), F.lit("00" * 12))
    packets = observations(spark, d).filter("rat = 'LTE'").select("session_id", "seq", F.lit(0xB114).alias("log_code"), F.unhex(body).alias("payload"))
    return decode.decode_packets(packets).select("session_id", "seq", "ta")


@register("c8_wcdma_identity", f"WITH {sql.OBS} SELECT session_id, seq, kind2 AS kind, freq::BIGINT AS freq, phy::BIGINT AS phy FROM (SELECT *, unnest(['passport', 'radio', 'serving']) AS kind2 FROM obs WHERE rat = 'WCDMA')")
def _(spark, d):
    mnc = F.lpad(F.col("mnc").cast("string"), 2, "0")
    body = F.concat(le_hex(F.col("freq") - 950, 4), le_hex(F.col("freq"), 4), le_hex(F.coalesce("cid", F.lit(0)), 4), F.lit("00000000"), le_hex(F.col("phy") * 16, 2), F.lit("020500"), F.concat(F.lit("0"), F.substring(mnc, 1, 1), F.lit("0"), F.substring(mnc, 2, 1), F.lit("0F")), le_hex(F.coalesce("tac", F.lit(0)), 4), F.lit("01000000"))
    packets = observations(spark, d).filter("rat = 'WCDMA'").select("session_id", "seq", F.lit(0x4027).alias("log_code"), F.unhex(body).alias("payload"))
    return decode.decode_packets(packets).select("session_id", "seq", "kind", "freq", "phy")


@register("c9_nr_mib", f"WITH {sql.OBS} SELECT session_id, seq, freq::BIGINT AS freq, phy::BIGINT AS phy FROM obs WHERE rat = 'NR'")
def _(spark, d):
    body = F.concat(F.lit("00000200"), le_hex(F.col("phy"), 2), le_hex(F.col("freq"), 4), F.lit("00" * 5))
    packets = observations(spark, d).filter("rat = 'NR'").select("session_id", "seq", F.lit(0xB822).alias("log_code"), F.unhex(body).alias("payload"))
    return decode.decode_packets(packets).select("session_id", "seq", "freq", "phy")


@register("c1_frames", f"WITH {sql.OBS} SELECT session_id, seq, (45056 + i)::INT AS log_code, seq::DECIMAL(20, 0) AS ts_ticks, '0102' AS payload FROM obs WHERE j % 4 <> 3")
def _(spark, d):
    code, ticks = le_hex(F.col("i") + 0xB000, 2), le_hex(F.col("seq"), 8)
    short = F.concat(F.lit("10001000"), code, ticks, F.lit("0102"))  # 16 bytes, the length counts all of them
    classic = F.concat(F.lit("10000E000E00"), code, ticks, F.lit("0102"), F.lit("00" * 40))  # padded
    frame = F.when(F.col("j") % 4 == 3, F.concat(F.lit("73"), F.substring(classic, 3, 200))).when(F.col("j") % 4 == 0, classic).otherwise(short)
    frames = durable(observations(spark, d).select("session_id", "seq", F.unhex(frame).alias("frame")), "frames")
    out = decode.frames_to_packets(frames)
    return out.withColumn("payload", F.hex("payload"))


@register("c11_bind_keys", f"WITH {sql.OBS} SELECT session_id, seq, 1 AS sub_seq, freq::BIGINT AS freq, phy::BIGINT AS phy FROM obs WHERE rat = 'LTE' AND phy <= 503 AND cid IS NOT NULL AND tac IS NOT NULL")
def _(spark, d):
    events = decode.decode_packets(_identity_packets(spark, d))
    loose = events.withColumns({c: F.when(F.col("kind") == "radio", F.col(c)) for c in ("freq", "phy")})
    return decode.bind_keys(loose).filter("kind = 'passport'").select("session_id", "seq", "sub_seq", "freq", "phy")


# ---- K: streams, run over the whole table and closed -------------------------------------------


def _stream(spark, d) -> DataFrame:
    """The observations as a file stream."""
    path = _folder(spark, "stream-in")
    observations(spark, d).withColumn("wall_time", F.col("wall_time").cast("timestamp")).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path)


def _drain(spark, stream: DataFrame, mode: str) -> DataFrame:
    """Every row of a stream over finite input, batches in order."""
    path, state = _folder(spark, "stream-out"), _folder(spark, "stream-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", path).parquet(f"{path}/part=*")


@register("k1_stream_registry", f"WITH {sql.OBS}, s AS (SELECT session_id, rat, arg_max((freq, phy), seq) AS at FROM obs WHERE kind = 'serving' GROUP BY ALL) SELECT o.session_id, o.rat, o.freq, o.phy, count(*) AS seen, arg_max(rsrp, seq) FILTER (WHERE kind = 'signal' AND (rat = 'NR' OR rsrp BETWEEN -150 AND -40)) AS rsrp, coalesce(any_value(s.at = (o.freq, o.phy)), FALSE) AS is_serving FROM obs o LEFT JOIN s USING (session_id, rat) WHERE kind <> 'neighbour' GROUP BY ALL")
def _(spark, d):
    cells = _drain(spark, live.stream_cells(_stream(spark, d), period=None, delay="3650 days"), "update")
    cells = cells.groupBy(*R.KEY).agg(F.max_by(F.struct("seen", "rsrp"), "batch_id").alias("c")).select(*R.KEY, "c.*")
    serving = _drain(spark, live.stream_serving(_stream(spark, d), period=None, delay="3650 days"), "update")
    serving = serving.groupBy("session_id", "rat").agg(F.max_by("at", "batch_id").alias("at"))
    return live.with_serving(cells, serving)


@register("k2_stream_identified", f"WITH {sql.OBS} SELECT DISTINCT session_id, cid AS eci FROM obs WHERE rat = 'LTE' AND kind = 'passport' AND cid IS NOT NULL AND tac IS NOT NULL AND phy <> 0")
def _(spark, d):
    passports = _stream(spark, d).filter("kind = 'passport'")
    return _drain(spark, live.stream_identified(passports, delay="36500 days"), "append").select("session_id", "eci")


@register("k4_publish_snapshots", f"WITH {sql.OBS} SELECT session_id, seq, rat, freq, phy, kind, cid FROM obs")
def _(spark, d):
    path = _folder(spark, "snapshots")
    live.publish_snapshots(_stream(spark, d), path, _folder(spark, "snapshots-state"), None).awaitTermination()
    live.latest_snapshot(spark, path).limit(1).count()
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("session_id", "seq", "rat", "freq", "phy", "kind", "cid")


@register("k5_stream_code_counts", f"WITH {sql.OBS} SELECT date_trunc('hour', wall_time) AS start, (45056 + i)::INT AS log_code, count(*) AS packets FROM obs GROUP BY ALL")
def _(spark, d):
    packets = _stream(spark, d).select("wall_time", (F.col("i") + 0xB000).alias("log_code"))
    out = _drain(spark, live.stream_code_counts(packets, delay="3650 days"), "update")
    return out.groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "log_code").agg(F.max_by("packets", "batch_id").alias("packets"))


@register("k7_cell_sessions", f"WITH {sql.OBS}, x AS (SELECT *, lag(wall_time) OVER (PARTITION BY session_id, rat, freq, phy ORDER BY wall_time) AS p FROM obs), y AS (SELECT *, sum((p IS NULL OR wall_time - p >= INTERVAL 1 HOUR)::INT) OVER (PARTITION BY session_id, rat, freq, phy ORDER BY wall_time) AS g FROM x) SELECT session_id, rat, freq, phy, count(*) AS events, min(wall_time) AS first_seen, max(wall_time) AS last_seen FROM y GROUP BY session_id, rat, freq, phy, g")
def _(spark, d):
    return live.stream_cell_sessions(observations(spark, d))

"""Queries over packets of all radio technologies, with their SQL twins.

Every row of ``events`` becomes one packet, whose bytes Spark lays out from the
observation; some are short, of unknown versions or out of range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import decode, rollups
from . import sql
from .catalog import observations, register


def le_hex(c, size: int):
    """Little-endian hex text of a whole number; negative ones as two's complement."""
    c = (F.col(c) if isinstance(c, str) else c).cast("long")
    text = F.lpad(F.hex(F.pmod(c, F.lit(1 << 8 * size)) if size < 8 else c), 2 * size, "0")
    return F.concat(*(F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))))


def _be(c: str, size: int) -> Column:
    return F.lpad(F.hex(F.coalesce(F.col(c), F.lit(0)).cast("long")), 2 * size, "0")


def _layout(*parts) -> Column:
    """Bytes from hex text and columns of hex text."""
    return F.unhex(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def _zeros(n: int) -> str:
    return "00" * n


def _or0(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def _plmn() -> Column:
    """250 and the two digits of the MNC, swapped."""
    return F.concat(F.lit("52F0"), F.reverse(F.lpad(F.col("mnc").cast("string"), 2, "0")))


def _choose(column: str, *cases: tuple[Column | int, Column]) -> tuple[Column, Column]:
    """(log code, payload) of the case whose number the column holds."""
    code, payload = F, F
    for i, (c, p) in enumerate(cases):
        code, payload = code.when(F.expr(column) == i, c if isinstance(c, Column) else F.lit(c)), payload.when(F.expr(column) == i, p)
    return code.alias("log_code"), payload.alias("payload")


def _packets(spark, d, rat: str, column: str, *cases) -> DataFrame:
    return observations(spark, d).filter(F.col("rat") == rat).select("session_id", "seq", *_choose(column, *cases))


# ---- C2, C3, H10: RRC wrappers ------------------------------------------------------------------

_RRC = """rrc0 AS (SELECT session_id, seq, phy, freq, CASE i WHEN 0 THEN 2 WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 25 WHEN 4 THEN 30 WHEN 6 THEN 2 END AS v,
    (CASE WHEN i = 2 THEN 12 + j % 4 ELSE 2 + j % 8 END)::INT AS p, CASE WHEN i = 4 THEN (seq % 8)::INT END AS s FROM obs WHERE rat = 'LTE'),
rrc AS (SELECT session_id, seq, v IS NOT NULL AND phy <= 503 AND seq % 11 <> 0 AS ok, phy, freq, v, p, s FROM rrc0)"""

_RRC_CHANNEL = """CASE WHEN v IN (2, 6) THEN CASE p WHEN 2 THEN 'BCCH_DL_SCH' WHEN 5 THEN 'DL_CCCH' WHEN 6 THEN 'DL_DCCH' WHEN 7 THEN 'UL_CCCH' WHEN 8 THEN 'UL_DCCH' END
    WHEN v = 9 THEN CASE p WHEN 12 THEN 'DL_CCCH' WHEN 13 THEN 'DL_DCCH' WHEN 14 THEN 'UL_CCCH' WHEN 15 THEN 'UL_DCCH' END
    WHEN v = 25 THEN CASE p WHEN 2 THEN 'BCCH_DL_SCH' WHEN 6 THEN 'DL_CCCH' WHEN 7 THEN 'DL_DCCH' WHEN 8 THEN 'UL_CCCH' WHEN 9 THEN 'UL_DCCH' END
    WHEN v = 30 THEN CASE p WHEN 3 THEN 'BCCH_DL_SCH' WHEN 8 THEN 'DL_CCCH' WHEN 9 THEN 'DL_DCCH' END END"""


def _wrappers(spark, d) -> DataFrame:
    """Wrappers of five layouts, one of an unknown version and one behind a flag byte; a declared length far beyond the body is refused."""
    pci, short, wide = le_hex("phy", 2), le_hex("freq", 2), le_hex("freq", 4)
    pdu = le_hex(F.when(F.col("i") == 2, 12 + F.col("j") % 4).otherwise(2 + F.col("j") % 8), 1)
    size = le_hex(F.when(F.col("seq") % 11 == 0, 200).otherwise(2), 2)
    oldest = ("02000000", pci, short, "0000", pdu, size, "0A0B")
    late = ("0000000000", pci, wide, "0000", pdu, "00000000", size)
    return _packets(
        spark, d, "LTE", "i", (0xB0C0, _layout(*oldest)), (0xB0C0, _layout("06000000", pci, short, "0000", pdu, "00000000", size, "0A0B")),
        (0xB0C0, _layout("09000000", pci, wide, "0000", pdu, "00000000", size, "0A0B")), (0xB0C0, _layout("19", *late, "0A0B")),
        (0xB0C0, _layout("1E", *late, "0000", le_hex(F.col("seq") % 8, 1), "0A0B")), (0xB0C0, _layout("01", _zeros(30))), (0xB0C0, _layout("01", *oldest)),
    )


@register("c2_rrc_header", f"""WITH {sql.OBS}, {_RRC} SELECT session_id, seq, CASE WHEN ok THEN v END::INT AS version, CASE WHEN ok THEN phy END AS pci, CASE WHEN ok THEN freq END AS earfcn,
    CASE WHEN ok THEN p END AS pdu, CASE WHEN ok THEN s END AS segment_id, CASE WHEN ok THEN {_RRC_CHANNEL} END AS channel, CASE WHEN ok THEN '0A0B' END AS body FROM rrc""")
def _(spark, d):
    return decode.decode_rrc_header(_wrappers(spark, d)).select("session_id", "seq", "version", "pci", "earfcn", "pdu", "segment_id", "channel", F.hex("body").alias("body"))


@register("c3_reassemble_rrc", f"""WITH {sql.OBS} SELECT session_id, count(*) AS messages, sum(n)::BIGINT AS bytes FROM (
    SELECT session_id, seq // 4 AS g, count(*) AS n FROM (SELECT (seq // 4) % 5 AS session_id, seq FROM obs) GROUP BY ALL HAVING count(*) = 4) GROUP BY ALL""")
def _(spark, d):
    segment = F.get(F.array(*map(F.lit, (1, 2, 3, 7))), (F.col("seq") % 4).cast("int"))
    wrapper = _layout("1E0000000000", "0200", "01000000", "0000", "03", "00000000", "0100", "0000", le_hex(segment, 1), le_hex(F.col("seq") % 256, 1))
    packets = observations(spark, d).select((F.floor(F.col("seq") / 4) % 5).alias("session_id"), "seq", wrapper.alias("payload"))
    whole = decode.reassemble_rrc(decode.decode_rrc_header(packets).filter("segment_id between 1 and 7"))
    return whole.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.octet_length("body")).alias("bytes"))


@register("h10_rrc_histogram", f"WITH {sql.OBS}, {_RRC} SELECT CASE WHEN ok THEN v ELSE -1 END::INT AS version, CASE WHEN ok THEN p ELSE -1 END::INT AS pdu, count(*) AS packets FROM rrc GROUP BY ALL")
def _(spark, d):
    return rollups.rrc_histogram(decode.decode_rrc_header(_wrappers(spark, d)).select("version", "pdu"))


# ---- C4-C6: LTE ---------------------------------------------------------------------------------


@register("c4_acquisition", f"""WITH {sql.OBS}, l AS (SELECT * FROM obs WHERE rat = 'LTE')
SELECT session_id, seq, 'radio' AS kind, freq::BIGINT AS freq, phy::BIGINT AS phy, seq % 1024 AS sfn, [1, 3, 5, 10, 15, 20, NULL][j % 7 + 1]::BIGINT AS bandwidth, NULL::BIGINT AS mnc FROM l WHERE i % 3 = 0 AND phy <= 503
UNION ALL SELECT session_id, seq, 'radio', freq, phy, NULL, NULL, NULL FROM l WHERE i % 3 = 1 AND phy BETWEEN 1 AND 503
UNION ALL SELECT session_id, seq, unnest(['radio', 'passport']), freq, 0, NULL, NULL, unnest([NULL, mnc]) FROM l WHERE i % 3 = 2""")
def _(spark, d):
    blocks = F.get(F.array(*map(F.lit, (6, 15, 25, 50, 75, 100, 7))), F.col("j") % 7)
    packets = _packets(
        spark, d, "LTE", "i % 3", (0xB0C1, _layout("02", le_hex("phy", 2), le_hex("freq", 4), le_hex(F.col("seq") % 1024, 2), "00", le_hex(blocks, 1))),
        (0xB176, _layout("20000000", le_hex("freq", 4), _zeros(12), le_hex("phy", 2))),
        (0xB0C4, _layout("02", _zeros(7), "03", _plmn(), le_hex("freq", 4), "02", _plmn(), _zeros(4), "05", _plmn(), le_hex("freq", 4))),
    )
    return decode.decode_packets(packets).select("session_id", "seq", "kind", "freq", "phy", "sfn", "bandwidth", "mnc")


@register("c5_cells", f"""WITH {sql.OBS}, l AS (SELECT *, (phy % 503 + 1)::BIGINT AS p1, ((phy + 100) % 503 + 1)::BIGINT AS p2, (400 + seq % 2000) / 16 - 180 AS level, (408 + seq % 2000) / 16 - 180 AS filtered,
    greatest(seq % 512, 100) / 16 - 30 AS quality, (seq % 512) * 1e-1::DOUBLE - 20 AS noise FROM obs WHERE rat = 'LTE'),
m AS (SELECT session_id, seq, freq, i, level, CASE WHEN filtered BETWEEN -150 AND -40 THEN filtered END AS filtered, CASE WHEN quality <= -1 THEN quality END AS quality, CASE WHEN noise > -20 THEN noise END AS noise, unnest([p1, p2]) AS p, unnest([TRUE, FALSE]) AS first FROM l),
heard AS (SELECT *, seq % 1024 AS sfn FROM m WHERE i % 3 = 0 AND level BETWEEN -150 AND -40)
SELECT session_id, seq, 'radio' AS kind, freq::BIGINT AS freq, 0::BIGINT AS phy, NULL::BIGINT AS sfn, NULL::DOUBLE AS rsrp, NULL::DOUBLE AS rsrq, NULL::DOUBLE AS rssi, NULL::DOUBLE AS rsrp_filtered, NULL::DOUBLE AS snr FROM l WHERE i % 3 = 0
UNION ALL SELECT session_id, seq, 'radio', freq, p, sfn, NULL, NULL, NULL, NULL, NULL FROM heard
UNION ALL SELECT session_id, seq, unnest(['signal', 'meas_nb']), freq, p, NULL, level, quality, -60, filtered, noise FROM heard
UNION ALL SELECT session_id, seq, 'serving', freq, p, NULL, NULL, NULL, NULL, NULL, NULL FROM heard WHERE first
UNION ALL SELECT session_id, seq, 'meas_nb', freq, p, NULL, level, -20, NULL, NULL, NULL FROM m WHERE i % 3 = 1 AND level BETWEEN -150 AND -40
UNION ALL SELECT session_id, seq, unnest(['radio', 'serving']), freq, p1, unnest([seq % 1024, NULL]), NULL, NULL, NULL, NULL, NULL FROM l WHERE i % 3 = 2""")
def _(spark, d):
    level, noise = 400 + F.col("seq") % 2000, F.col("seq") % 512
    codes = (F.col("phy") % 503 + 1, (F.col("phy") + 100) % 503 + 1)

    def cell(word):
        middle = (le_hex(F.col("seq") % 1024, 2), _zeros(30), le_hex(level + (level + 8) * 4096, 4), le_hex(noise, 2), "0000", le_hex(F.lit(100), 2), "0000", le_hex(F.lit(200 << 20), 4))
        return (le_hex(word, 2), "0000", *middle, _zeros(8), le_hex(F.lit(800), 2), _zeros(30), le_hex(noise, 4), _zeros(44))

    record = lambda code: (le_hex(code * (1 << 23) + level, 4), _zeros(4), le_hex(F.lit(160 << 12), 4), _zeros(20))
    packets = _packets(
        spark, d, "LTE", "i % 3",
        (0xB193, _layout("01010000", "1930", le_hex(F.lit(4 + 12 + 280), 2), le_hex("freq", 4), "02000300", _zeros(4), *cell(codes[0] + 4096), *cell(codes[1]))),
        (0xB180, _layout("05000000", le_hex("freq", 4), le_hex(F.lit(2 << 6), 4), *record(codes[0].cast("long")), *record(codes[1].cast("long")))),
        (0xB197, _layout("0200", le_hex(F.col("seq") % 1024, 2), le_hex("freq", 4), le_hex(codes[0], 2), "0000")),
    )
    return decode.decode_packets(packets).select("session_id", "seq", "kind", "freq", "phy", "sfn", "rsrp", "rsrq", "rssi", "rsrp_filtered", "snr")


@register("c6_registration", f"""WITH {sql.OBS}, l AS (SELECT * FROM obs WHERE rat = 'LTE'), cells AS (SELECT session_id, seq, freq, unnest(CASE j % 2 WHEN 0 THEN [phy & 511] ELSE [phy & 511, (phy + 18) & 511] END) AS p FROM l WHERE i % 2 = 0)
SELECT session_id, seq, 'radio' AS kind, freq::BIGINT AS freq, p::BIGINT AS phy, NULL::BIGINT AS emm_state, NULL::BIGINT AS emm_substate, NULL::BIGINT AS mnc, NULL::BIGINT AS mme_group, NULL::BIGINT AS mme_code FROM cells WHERE p BETWEEN 1 AND 503
UNION ALL SELECT session_id, seq, 'inter_carriers', freq, NULL, NULL, NULL, NULL, NULL, NULL FROM cells GROUP BY ALL HAVING NOT bool_or(p BETWEEN 1 AND 503)
UNION ALL SELECT session_id, seq, 'registration', NULL, NULL, j % 7, i, mnc, CASE WHEN j % 2 = 1 THEN 13953 END, CASE WHEN j % 2 = 1 THEN 224 END FROM l WHERE i % 2 = 1""")
def _(spark, d):
    found = ("7A", F.when(F.col("j") % 2 == 0, F.lit("20")).otherwise(F.lit("40")), "0000", le_hex("freq", 4), "0000", le_hex("phy", 2), _zeros(12), "0000", le_hex(F.col("phy") + 18, 2), _zeros(12))
    state = ("02", le_hex(F.col("j") % 7, 1), le_hex("i", 1), "00", _plmn(), le_hex(F.col("j") % 2, 1), "00", _plmn(), "3681E0", _zeros(4))
    packets = _packets(spark, d, "LTE", "i % 2", (0xB115, _layout(*found)), (0xB0EE, _layout(*state)))
    return decode.decode_packets(packets).select("session_id", "seq", "kind", "freq", "phy", "emm_state", "emm_substate", "mnc", "mme_group", "mme_code")


# ---- C7, C10: GSM and modem events ----------------------------------------------------------------


@register("c7_gsm", f"""WITH {sql.OBS}, g AS (SELECT *, -((seq % 1600) // 16) AS level FROM obs WHERE rat = 'GSM')
SELECT session_id, seq, unnest(['radio', 'serving']) AS kind, freq::BIGINT AS freq, phy::BIGINT AS phy, NULL::BIGINT AS cid, NULL::BIGINT AS tac, NULL::BIGINT AS mnc,
    NULL::BIGINT AS rxlev, NULL::BIGINT AS max_tx, NULL::BIGINT AS rxlev_min, NULL::BIGINT AS reselect_offset, NULL::BIGINT AS penalty_time, NULL::DOUBLE AS snr FROM g WHERE i = 0 AND cid IS NULL
UNION ALL SELECT session_id, seq, unnest(['radio', 'serving', 'passport']), freq, phy, unnest([NULL, NULL, cid]), unnest([NULL, NULL, coalesce(tac, 0)]), unnest([NULL, NULL, mnc]), NULL, NULL, NULL, NULL, NULL, NULL FROM g WHERE i = 0 AND cid IS NOT NULL
UNION ALL SELECT session_id, seq, unnest(['radio', 'passport']), NULL, NULL, unnest([NULL, cid]), unnest([NULL, coalesce(tac, 0)]), unnest([NULL, mnc]), NULL, unnest([5, NULL]), unnest([8, NULL]), unnest([j, NULL]), unnest([17, NULL]), NULL FROM g WHERE i IN (1, 2) AND cid IS NOT NULL
UNION ALL SELECT session_id, seq, unnest(['radio', 'passport']), NULL, NULL, NULL, unnest([NULL, coalesce(tac, 0)]), unnest([NULL, mnc]), NULL, unnest([5, NULL]), unnest([8, NULL]), NULL, NULL, NULL FROM g WHERE i = 3
UNION ALL SELECT session_id, seq, 'gsm_nb', unnest([freq, freq + 1]), unnest([phy, NULL]), NULL, NULL, NULL, level, NULL, NULL, NULL, NULL, NULL FROM g WHERE i = 4
UNION ALL SELECT session_id, seq, 'gsm_nb', freq, NULL, NULL, NULL, NULL, level, NULL, NULL, NULL, NULL, NULL FROM g WHERE i = 5
UNION ALL SELECT session_id, seq, unnest(['gsm_nb', 'signal']), unnest([freq, NULL]), NULL, NULL, NULL, NULL, level, NULL, NULL, NULL, NULL, unnest([NULL, -j]) FROM g WHERE i = 6""")
def _(spark, d):
    dual = F.col("j") % 2 == 1
    front = F.when(dual, F.lit("01")).otherwise(F.lit(""))
    code = lambda one, two: F.when(dual, F.lit(two)).otherwise(F.lit(one))
    cid, lai, power = _be("cid", 2), F.concat(_plmn(), _be("tac", 2)), le_hex(-(F.col("seq") % 1600), 2)
    rest = ("00000000", "25C8", "0000AA", le_hex(128 + F.col("j"), 1), "51")  # from the control channel on; penalty 17
    entry = lambda freq, valid: (le_hex(freq, 2), power, valid, le_hex("phy", 1), _zeros(6))
    packets = _packets(
        spark, d, "GSM", "i",
        (code(0x5134, 0x5B34), _layout(front, le_hex(F.col("freq") + 9 * 4096, 2), le_hex(F.col("phy") % 8, 1), le_hex(F.floor(F.col("phy") / 8), 1), le_hex(_or0("cid"), 2), lai, "00FF")),
        (code(0x512F, 0x5B2F), _layout(front, "49061B", cid, lai, *rest)),
        (code(0x512F, 0x5B2F), _layout(front, "491B15", "55061B", cid, lai, *rest)),
        (code(0x512F, 0x5B2F), _layout(front, "49061C", lai, "25C8000000")),
        (code(0x5071, 0x5A71), _layout(front, "02", *entry("freq", "01"), *entry(F.col("freq") + 1, "00"))),
        (code(0x507B, 0x5A7B), _layout(front, "02", le_hex("freq", 2), power, "00")),
        (0x506A, _layout("04", _zeros(5), le_hex("freq", 2), _zeros(4), power, _zeros(8), le_hex(-F.col("j"), 2))),
    )
    columns = ("kind", "freq", "phy", "cid", "tac", "mnc", "rxlev", "max_tx", "rxlev_min", "reselect_offset", "penalty_time", "snr")
    return decode.decode_packets(packets).select("session_id", "seq", *columns)


@register("c10_events", f"""WITH {sql.OBS} SELECT session_id, seq, CASE i % 2 WHEN 0 THEN 'LTE' ELSE 'GSM' END AS rat, CASE i % 2 WHEN 0 THEN 'radio' ELSE 'hint' END AS kind,
    CASE i % 2 WHEN 1 THEN seq % 1024 END AS freq, CASE i % 2 WHEN 0 THEN (j % 10)::BIGINT END AS rrc_state FROM obs WHERE rat = 'LTE' AND CASE i % 2 WHEN 0 THEN j % 10 <= 7 ELSE seq % 1024 <> 0 END""")
def _(spark, d):
    brief = F.col("j") % 3 == 0
    head = lambda word: F.concat(F.lit("0000"), le_hex(F.when(brief, word + 0x8000).otherwise(word), 2), F.when(brief, F.lit("0102")).otherwise(F.lit("0102030405060708")))
    state, hint = head(1606 | 1 << 13), head(500 | 2 << 13)
    packets = _packets(spark, d, "LTE", "i % 2", (0, _layout(state, le_hex(F.col("j") % 10, 1))), (0, _layout(hint, le_hex(F.col("seq") % 1024, 2))))
    return decode.decode_packets(packets).select("session_id", "seq", "rat", "kind", "freq", "rrc_state")


# ---- C8, C9: WCDMA and NR -------------------------------------------------------------------------


@register("c8_ranks", f"""WITH {sql.OBS}, w AS (SELECT * EXCLUDE (rscp), greatest(-(seq % 100) - 21, -140) AS rscp, -((seq % 40) // 2) AS ecio FROM obs WHERE rat = 'WCDMA')
SELECT session_id, seq, 'WCDMA' AS rat, unnest(['radio', 'signal', 'serving']) AS kind, freq::BIGINT AS freq, phy::BIGINT AS phy, unnest([NULL, rscp, NULL])::BIGINT AS rscp, unnest([NULL, ecio, NULL])::BIGINT AS ecio, NULL::BIGINT AS rxlev FROM w WHERE j % 2 = 0
UNION ALL SELECT session_id, seq, 'WCDMA', 'wcdma_nb', freq, phy + 1, rscp, ecio, NULL FROM w WHERE j % 2 = 0
UNION ALL SELECT session_id, seq, 'GSM', 'gsm_nb', 10 + i, j, NULL, NULL, -(seq % 100) FROM w WHERE j % 2 = 0
UNION ALL SELECT session_id, seq, 'WCDMA', unnest(['radio', 'wcdma_nb', 'wcdma_nb']), freq, unnest([0, phy, phy + 2]), NULL, NULL, NULL FROM w WHERE j % 2 = 1""")
def _(spark, d):
    level = le_hex(-(F.col("seq") % 100), 1)
    rank = lambda code: (le_hex("freq", 2), le_hex(code, 2), level, "0000", le_hex(-(F.col("seq") % 40), 1), _zeros(8))
    packets = _packets(
        spark, d, "WCDMA", "j % 2", (0x4005, _layout("8201", _zeros(5), *rank(F.col("phy")), *rank(F.col("phy") + 1), le_hex(10 + F.col("i"), 2), le_hex("j", 1), level, _zeros(9))),
        (0x4111, _layout("00", le_hex("freq", 2), "03", le_hex("phy", 2), _zeros(5), le_hex(F.col("phy") + 2, 2), _zeros(5), le_hex(F.lit(600), 2))),
    )
    return decode.decode_packets(packets).select("session_id", "seq", "rat", "kind", "freq", "phy", "rscp", "ecio", "rxlev")


@register("c9_nr_measurements", f"""WITH {sql.OBS}, r AS (SELECT *, seq % 1500 AS b1, (seq * 7) % 1500 AS b2 FROM obs WHERE rat = 'NR')
SELECT session_id, seq, 'radio' AS kind, freq::BIGINT AS freq, phy::BIGINT AS phy, (freq - 1000)::BIGINT AS ul_freq, 78::BIGINT AS band, NULL::BIGINT AS cid, NULL::BIGINT AS tac, NULL::DOUBLE AS rsrp, NULL::DOUBLE AS rsrq, NULL::DOUBLE AS snr FROM r WHERE j % 3 = 0
UNION ALL SELECT session_id, seq, 'passport', freq, phy, NULL, NULL, cid, tac, NULL, NULL, NULL FROM r WHERE j % 3 = 0 AND cid IS NOT NULL
UNION ALL SELECT session_id, seq, unnest(['signal', 'serving']), freq, phy, NULL, NULL, NULL, NULL, unnest([b1 / 16 - 180, NULL]), unnest([-20, NULL]), unnest([0, NULL]) FROM r WHERE j % 3 = 1
UNION ALL SELECT session_id, seq, 'meas_nb', freq, phy, NULL, NULL, NULL, NULL, greatest(b1, b2) / 16 - 180, CASE WHEN b2 > b1 THEN -19.375 ELSE -20 END, 0 FROM r WHERE j % 3 = 2 AND greatest(b1, b2) > 0""")
def _(spark, d):
    pci, freq, zero_db = le_hex("phy", 2), le_hex("freq", 4), 320 << 12
    beam = lambda level, quality: (le_hex(level * 1024, 4), le_hex(F.lit(quality + zero_db), 4))
    cell = ("04000000", pci, freq, le_hex(F.col("freq") - 1000, 4), "64006400", le_hex(_or0("cid"), 8), le_hex("mcc", 2), "02", le_hex("mnc", 2), "00", le_hex(_or0("tac"), 4), "4E00")
    serving = ("00000100", "0101", le_hex(F.lit(28), 2), freq, le_hex("phy", 4), _zeros(4), le_hex(F.col("seq") % 1500, 4), le_hex(F.lit(160 + zero_db), 4), _zeros(4))
    near = ("00000100", "0101", le_hex(F.lit(32), 2), freq, "01000000", le_hex(F.col("phy") + 2 * 1024, 4), *beam(F.col("seq") % 1500, 160), *beam(F.col("seq") * 7 % 1500, 170))
    packets = _packets(spark, d, "NR", "j % 3", (0xB823, _layout(*cell)), (0xB992, _layout(*serving)), (0xB97F, _layout(*near)))
    return decode.decode_packets(packets).select("session_id", "seq", "kind", "freq", "phy", "ul_freq", "band", "cid", "tac", "rsrp", "rsrq", "snr")


# ---- C11, R13: from packets to the registry --------------------------------------------------------

# What the packets of LTE cells mean, in the columns of the observations; seq * 8 + place orders the events of a packet.
_TOLD = sql.OBS.replace("obs AS (", "obs0 AS (") + f""",
l AS (SELECT *, {{'freq': freq, 'phy': phy}} AS key, kind = 'signal' AND rsrp BETWEEN -150 AND -40 AS good FROM obs0 WHERE rat = 'LTE' AND phy BETWEEN 1 AND 485),
l1 AS (SELECT *, last_value(CASE WHEN good OR kind = 'serving' THEN key END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM l),
l2 AS (SELECT l1.*, (SELECT arg_min(p.mnc, p.seq) FROM l p WHERE p.kind = 'passport' AND p.cid IS NOT NULL AND p.tac IS NOT NULL AND p.session_id = l1.session_id AND p.key = l1.s AND p.seq < l1.seq) AS s_mnc FROM l1),
e AS (
  SELECT session_id, seq * 8 AS seq, wall_time, 'radio' AS kind, freq, phy, NULL::INT AS mcc, NULL::INT AS mnc, NULL::INT AS tac, NULL::BIGINT AS cid,
    NULL::DOUBLE AS rsrp, NULL::DOUBLE AS rsrq, NULL::DOUBLE AS rssi, ul_freq, NULL::INT AS ta, NULL::INT AS nb_freq, NULL::INT AS nb_phy FROM l WHERE kind = 'passport'
  UNION ALL SELECT session_id, seq * 8 + 1, wall_time, 'passport', freq, phy, mcc, mnc, tac, cid, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM l WHERE kind = 'passport' AND cid IS NOT NULL AND tac IS NOT NULL
  UNION ALL SELECT session_id, seq * 8 + place, wall_time, k, freq, phy, NULL, NULL, NULL, NULL, CASE k WHEN 'signal' THEN rsrp END, CASE k WHEN 'signal' THEN (seq % 480) / 16 - 30 END,
    CASE k WHEN 'signal' THEN (seq % 1000) / 16 - 110 END, NULL, NULL, NULL, NULL FROM (SELECT *, unnest(['radio', 'signal', 'serving']) AS k, unnest([0, 1, 2]) AS place FROM l WHERE good)
  UNION ALL SELECT session_id, seq * 8 + place, wall_time, k, freq, phy, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM (SELECT *, unnest(['radio', 'serving']) AS k, unnest([0, 1]) AS place FROM l WHERE kind = 'serving')
  UNION ALL SELECT session_id, seq * 8, wall_time, 'radio', s.freq, s.phy, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, seq % 1283, NULL, NULL FROM l1 WHERE kind = 'radio' AND s IS NOT NULL
  UNION ALL SELECT session_id, seq * 8, wall_time, 'neighbour', s.freq, s.phy, CASE WHEN s_mnc IS NOT NULL THEN 250 END, s_mnc, NULL, NULL, (400 + seq % 2000) / 16 - 180, -20, NULL, NULL, NULL, freq, phy + 18
    FROM l2 WHERE kind = 'neighbour' AND (400 + seq % 2000) / 16 - 180 BETWEEN -150 AND -40),
obs AS (SELECT *, 'LTE' AS rat, 'meas' AS nb_source, NULL::DOUBLE AS snr, NULL::DOUBLE AS rscp, NULL::DOUBLE AS rxlev, NULL::INT AS bandwidth, NULL::INT AS rrc_state, NULL::INT AS emm_state,
    NULL::INT AS emm_substate, NULL::BOOLEAN AS barring_emergency, NULL::INT AS mnc_digits, NULL::INT AS rac, NULL::BOOLEAN AS barred, NULL::INT AS nb_thresh_high, NULL::INT AS nb_offset FROM e)"""


@register(
    "c11_packets_to_registry",
    f"WITH {sql.REGISTRY.replace(sql.OBS, _TOLD).rstrip().rstrip(',')}"
    " SELECT session_id, rat, freq, phy, mcc, mnc, tac, cid, rsrp, rsrq, rssi, ul_freq, ta, seen, first_seq // 8 AS first_seq, last_seq // 8 AS last_seq, plmn_source, is_serving, ever_serving FROM reg",
)
def _(spark, d):
    """Identity (B0C2), measurement (B17F), serving (B197), timing (B114) and neighbour (B180) packets, of which the last two bear no key of the cell that told them."""
    area, cid = F.col("tac").isNotNull() & F.col("cid").isNotNull(), F.coalesce("cid", F.lit(0))
    level, raw = 400 + F.col("seq") % 2000, ((F.col("rsrp") + 180) * 16).cast("long")
    pci, freq = le_hex("phy", 2), le_hex("freq", 4)
    kinds = F.array_position(F.array(*map(F.lit, ("passport", "signal", "serving", "radio", "neighbour"))), F.col("kind"))
    obs = observations(spark, d).filter("rat = 'LTE' and phy between 1 and 485").withColumn("k", kinds - 1)
    code, payload = _choose(
        "k", (0xB0C2, _layout("03", pci, freq, le_hex("ul_freq", 4), "0000", le_hex(F.when(area, cid).otherwise(0), 4), le_hex(F.when(area, F.col("tac")).otherwise(0), 2), _zeros(4), le_hex("mcc", 2), "02", le_hex("mnc", 2), "00")),
        (0xB17F, _layout("05000000", freq, pci, "0000", le_hex(raw, 4), _zeros(4), le_hex((F.col("seq") % 480) * (1 << 22), 4), le_hex((F.col("seq") % 1000) * (1 << 11), 4))),
        (0xB197, _layout("0200", "0000", freq, pci, "0000")), (0xB114, _layout("A100", le_hex((F.col("seq") % 1283) * 2, 2), _zeros(12))),
        (0xB180, _layout("05000000", freq, le_hex(F.lit(1 << 6), 4), le_hex((F.col("phy") + 18).cast("long") * (1 << 23) + level, 4), _zeros(4), le_hex(F.lit(160 << 12), 4), _zeros(20))),
    )
    cells = decode.packets_to_registry(obs.select("session_id", "seq", "wall_time", code, payload))
    return cells.select(
        "session_id", "rat", "freq", "phy", "mcc", "mnc", "tac", "cid", "rsrp", "rsrq", "rssi", "ul_freq", "ta", "seen", "first_seq", "last_seq", "plmn_source", "is_serving", "ever_serving"
    )

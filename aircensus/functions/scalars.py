"""Radio scalars: dB conversions, guards, bands, identifiers and labels.

Every function maps columns to a column with built-in expressions only.  A null
input gives null unless the docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Commercial LTE bands (band, duplex, first and last DL EARFCN, DL MHz at the first, UL MHz or 0).
LTE_BANDS = (
    (1, "FDD", 0, 599, 2110.0, 1920.0),
    (3, "FDD", 1200, 1949, 1805.0, 1710.0),
    (7, "FDD", 2750, 3449, 2620.0, 2500.0),
    (8, "FDD", 3450, 3799, 925.0, 880.0),
    (20, "FDD", 6150, 6449, 791.0, 832.0),
    (28, "FDD", 9210, 9659, 758.0, 703.0),
    (38, "TDD", 37750, 38249, 2570.0, 0.0),
    (40, "TDD", 38650, 39649, 2300.0, 0.0),
    (41, "TDD", 39650, 41589, 2496.0, 0.0),
)
# UMTS bands (name, first and last DL UARFCN, offset of the UL UARFCN).
UMTS_BANDS = (("B1", 10562, 10838, 950), ("B8", 2937, 3088, 225), ("B5", 4357, 4458, 225))
# GSM bands (name, first and last ARFCN).
GSM_BANDS = (("GSM900", 0, 124), ("GSM900", 975, 1023), ("GSM850", 128, 251), ("GSM450", 259, 293), ("GSM480", 306, 340), ("DCS1800", 512, 885))
# Operator brands by PLMN.
OPERATORS = {
    "250-01": "MTS",
    "250-02": "MegaFon",
    "250-11": "Yota",
    "250-20": "t2",
    "250-32": "Win Mobile",
    "250-35": "Motiv",
    "250-50": "SberMobile",
    "250-99": "Beeline",
}


# B1: raw modem units to dB(m).
def ml1_rsrp(raw: Col) -> Column:
    return _c(raw) / 16 - 180


def ml1_rsrq(raw: Col) -> Column:
    return _c(raw) / 16 - 30


def ml1_rssi(raw: Col) -> Column:
    return _c(raw) / 16 - 110


def ftl_snr(raw: Col) -> Column:
    return _c(raw) * F.lit(0.1) - 20


def nr_sinr(raw: Col) -> Column:
    return _c(raw) / 16 - 20


# B2: validity guards; null is not valid.
def _within(c: Col, low, high) -> Column:
    return F.coalesce(_c(c).between(low, high), F.lit(False))


def valid_earfcn(c: Col) -> Column:
    return _within(c, 1, 262143)


def valid_pci(c: Col) -> Column:
    return _within(c, 0, 503)


def valid_eci(c: Col) -> Column:
    return _within(c, 1, 0x0FFFFFFF)


def valid_tac(c: Col) -> Column:
    return _within(c, 1, 0xFFFE)


def valid_rsrp(c: Col) -> Column:
    return _within(c, -150, -40)


def valid_nr_arfcn(c: Col) -> Column:
    return _within(c, 1, 3279165)


def valid_nr_pci(c: Col) -> Column:
    return _within(c, 0, 1007)


def sane_plmn(mcc: Col, mnc: Col) -> Column:
    return _within(mcc, 100, 999) & _within(mnc, 0, 999)


# Which end of a packed word holds the PCI.
def pci_packing(word: Col) -> Column:
    """'LSB', 'MSB' or null where the word refutes neither."""
    w = _c(word)
    low, high = w.bitwiseAND(511), F.shiftright(w, 7).bitwiseAND(511)
    low_ok, high_ok = low.between(1, 503), high.between(1, 503)
    return (
        F.when(high_ok & ~low_ok, "MSB").when(low_ok & ~high_ok, "LSB")
        .when(low_ok & high_ok & (w.bitwiseAND(127) > 7), "LSB")
    )


def unpack_pci(word: Col, hint: Col | None = None) -> Column:
    """struct(pci, prio, pack): by refutation, else by the hint, else LSB if that is a legal PCI."""
    w = _c(word)
    low = w.bitwiseAND(511)
    fallback = F.when(low.between(1, 503), "LSB").otherwise("MSB")
    pack = F.coalesce(pci_packing(w), *([_c(hint)] if hint is not None else []), fallback)
    lsb = pack == "LSB"
    return F.struct(
        F.when(lsb, low).otherwise(F.shiftright(w, 7).bitwiseAND(511)).alias("pci"),
        F.when(lsb, F.shiftright(w, 9).bitwiseAND(7)).otherwise(w.bitwiseAND(7)).alias("prio"),
        pack.alias("pack"),
    )


# Channel number to band.
def lte_band(earfcn: Col, hint: Col | None = None) -> Column:
    """struct(band, duplex, name, dl_mhz, ul_mhz); a hint restricts the bands and, alone, names one without MHz."""
    n = _c(earfcn)
    h = _c(hint) if hint is not None else F.lit(None).cast("int")
    no_hint = F.coalesce(h == 0, F.lit(True))
    kind = "struct<band:int,duplex:string,name:string,dl_mhz:double,ul_mhz:double>"

    def row(band, duplex, first, low, up, mhz):
        down = F.lit(low) + F.lit(0.1) * (n - first)
        dl, ul = (down, F.lit(up) + F.lit(0.1) * (n - first) if duplex == "FDD" else down) if mhz else (F.lit(None), F.lit(None))
        return F.struct(F.lit(band).alias("band"), F.lit(duplex).alias("duplex"), F.lit(f"B{band}").alias("name"), dl.alias("dl_mhz"), ul.alias("ul_mhz")).cast(kind)

    out = F.lit(None).cast(kind)
    for band, duplex, first, _last, low, up in reversed(LTE_BANDS):
        out = F.when(h == band, row(band, duplex, first, low, up, False)).otherwise(out)
    for band, duplex, first, last, low, up in reversed(LTE_BANDS):
        out = F.when(n.between(first, last) & (no_hint | (h == band)), row(band, duplex, first, low, up, True)).otherwise(out)
    return out


def lte_band_number(earfcn: Col) -> Column:
    out = F.lit(None).cast("int")
    for band, _, first, last, *_ in LTE_BANDS:
        out = F.when(_c(earfcn).between(first, last), band).otherwise(out)
    return out


def lte_is_fdd(earfcn: Col) -> Column:
    return F.coalesce(lte_band_number(earfcn) < 33, F.lit(False))


def lte_duplex(band: Col) -> Column:
    b = _c(band)
    return F.when(b.between(33, 51), "TDD").when(b > 0, "FDD").otherwise("Unknown")


def umts_band(uarfcn: Col) -> Column:
    """struct(name, dl_mhz, ul_mhz), null outside the known bands."""
    n = _c(uarfcn)
    out = F.lit(None).cast("struct<name:string,dl_mhz:double,ul_mhz:double>")
    for name, first, last, offset in UMTS_BANDS:
        out = F.when(n.between(first, last), F.struct(F.lit(name).alias("name"), (n / 5).alias("dl_mhz"), ((n - offset) / 5).alias("ul_mhz"))).otherwise(out)
    return out


def gsm_band(arfcn: Col, class_hint: Col | None = None) -> Column:
    n = _c(arfcn)
    out = F.lit(None).cast("string")
    for name, first, last in GSM_BANDS:
        value = F.when(_c(class_hint) == 1, "PCS1900").otherwise(name) if name == "DCS1800" and class_hint is not None else F.lit(name)
        out = F.when(n.between(first, last), value).otherwise(out)
    return out


# GSM cell (re)selection criteria.
def gsm_max_power(band: Col) -> Column:
    return F.when(_c(band).isin("DCS1800", "PCS1900"), 30).otherwise(33)


def gsm_power_level(level: Col, band: Col) -> Column:
    n = _c(level)
    high = F.when(n <= 28, 30 - 2 * n).when(n == 29, 36).when(n == 30, 34).when(n == 31, 32).otherwise(30)
    low = F.when(n <= 2, 39).when(n <= 19, 39 - 2 * (n - 2)).otherwise(5)
    return F.when(_c(band).isin("DCS1800", "PCS1900"), high).otherwise(low)


def gsm_c1(rxlev_dbm: Col, rxlev_access_min: Col, ms_txpwr: Col, band: Col) -> Column:
    units = F.least(F.greatest(_c(rxlev_dbm) + 110, F.lit(0)), F.lit(63))
    excess = F.greatest(gsm_power_level(ms_txpwr, band) - gsm_max_power(band), F.lit(0))
    return units - _c(rxlev_access_min) - excess


def gsm_c2(c1: Col, cro: Col, penalty_time: Col, present: Col | None = None) -> Column:
    step = 2 * _c(cro)
    return F.when(~(_c(present) if present is not None else F.lit(True)), _c(c1)).when(_c(penalty_time) == 31, _c(c1) - step).otherwise(_c(c1) + step)


# Parts of cell ids.
def enb_id(eci: Col) -> Column:
    return F.shiftright(_c(eci), 8).bitwiseAND(0xFFFFF)


def sector(eci: Col) -> Column:
    return _c(eci).bitwiseAND(0xFF)


def rnc_id(cid: Col) -> Column:
    return F.shiftright(_c(cid), 16).bitwiseAND(0xFFF)


def cid16(cid: Col) -> Column:
    return _c(cid).bitwiseAND(0xFFFF)


# PLMN text and operators.
def format_plmn(mcc: Col, mnc: Col, digits: Col | None = None) -> Column:
    """'mcc-mnc' with two digits of mnc, three if it has them or ``digits`` is 3; '' without an mcc."""
    three = F.coalesce((_c(mnc) >= 100) | (_c(digits) == 3 if digits is not None else F.lit(False)), F.lit(False))
    text = F.lpad(F.coalesce(_c(mnc), F.lit(0)).cast("string"), F.when(three, 3).otherwise(2), F.lit("0"))
    return F.when(F.coalesce(_c(mcc), F.lit(0)) == 0, "").otherwise(F.concat(_c(mcc).cast("string"), F.lit("-"), text))


def parse_plmn(text: Col) -> Column:
    """struct(mcc, mnc) of '250-01' or '25001' (five or six digits, mcc 100..999); null otherwise."""
    digits = F.regexp_replace(F.trim(_c(text)), "-", "")
    mcc = F.substring(digits, 1, 3).cast("int")
    return F.when(digits.rlike("^[0-9]{5,6}$") & (mcc >= 100), F.struct(mcc.alias("mcc"), F.substring(digits, 4, 3).cast("int").alias("mnc")))


def normalize_plmn(text: Col) -> Column:
    """Digits as 'ddd-rest' if there are five at least, else the trimmed text; null becomes ''."""
    raw = F.coalesce(F.trim(_c(text)), F.lit(""))
    digits = F.regexp_replace(raw, "[^0-9]", "")
    return F.when(F.length(digits) >= 5, F.concat(F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 100))).otherwise(raw)


def operator_brand(plmn: Col) -> Column:
    out = F.lit("")
    for key, name in OPERATORS.items():
        out = F.when(_c(plmn) == key, name).otherwise(out)
    return out


def operator_label(plmn: Col) -> Column:
    """Brand, else the PLMN, else 'Unknown PLMN'."""
    brand = operator_brand(plmn)
    return F.when(brand != "", brand).when(F.coalesce(_c(plmn), F.lit("")) != "", _c(plmn)).otherwise("Unknown PLMN")


# B11, B12, B17.
def rat_of_code(code: Col) -> Column:
    n = _c(code)
    nibble = F.shiftright(n, 12).bitwiseAND(15)
    return F.when(n >= 0xB800, "NR").when(nibble == 11, "LTE").when(nibble == 5, "GSM").when(nibble.isin(4, 7), "WCDMA").otherwise("UNKNOWN")


def ta_distance_m(ta: Col) -> Column:
    return F.when(_c(ta) != 0, F.floor(_c(ta) * F.lit(78.125) + 0.5).cast("int"))


def bw_from_index(index: Col) -> Column:
    """MHz of a bandwidth index 0..5 (1 stands for 1.4)."""
    return F.get(F.array(*map(F.lit, (1, 3, 5, 10, 15, 20))), _c(index).cast("int"))


def bw_from_nrb(nrb: Col) -> Column:
    """MHz of a number of resource blocks; other values pass through."""
    n = _c(nrb)
    out = n
    for blocks, mhz in ((6, 1), (15, 3), (25, 5), (50, 10), (75, 15), (100, 20)):
        out = F.when(n == blocks, mhz).otherwise(out)
    return out


# How much is known of a cell.
def has_identity(cid: Col, tac: Col) -> Column:
    return valid_eci(cid) & valid_tac(tac)


def fill_status(rat: Col, freq: Col, phy: Col, mcc: Col, cid: Col, tac: Col) -> Column:
    nonzero = lambda c: F.coalesce(_c(c) != 0, F.lit(False))
    wcdma = _c(rat) == "WCDMA"
    radio = F.when(wcdma, _within(freq, 1, 16383) & _within(phy, 0, 511)).otherwise(nonzero(freq) & nonzero(phy))
    known = F.when(wcdma, nonzero(cid) & nonzero(tac)).otherwise(has_identity(cid, tac))
    plmn = nonzero(mcc)
    return F.when(radio & plmn & known, "FULL").when(radio & plmn, "PLMN").when(radio, "RADIO").when(plmn, "WEAK").otherwise("EMPTY")


def matches_completeness(kind: str, cid: Col, tac: Col, mcc: Col, is_serving: Col, ever_serving: Col) -> Column:
    """Membership of a class: All, Radio (no cell id), Full, Camped (served, with a cell id) or Serving."""
    has_cid = F.coalesce(_c(cid) != 0, F.lit(False))
    serving = F.coalesce(_c(is_serving), F.lit(False))
    classes = {
        "All": F.lit(True),
        "Radio": ~has_cid,
        "Full": has_cid,
        "Camped": has_cid & (serving | F.coalesce(_c(ever_serving), F.lit(False))),
        "Serving": serving,
    }
    return classes[kind]


def plmn_trusted(mcc: Col, mnc: Col, soft: Col, cid: Col) -> Column:
    """The PLMN text, '' if it was only spread to a cell without a cell id."""
    return F.when(F.coalesce(_c(soft), F.lit(False)) & F.coalesce(_c(cid) == 0, F.lit(True)), "").otherwise(format_plmn(mcc, mnc))


# The first value that is set.
def first_set(*values: Col) -> Column:
    return F.coalesce(*(F.nullif(_c(v), F.lit("")) for v in values), F.lit(""))


def channel(radio: Col) -> Column:
    return first_set(*(F.element_at(_c(radio), F.lit(k)) for k in ("earfcn", "uarfcn", "arfcn", "nrarfcn")))


def cell_code(radio: Col) -> Column:
    return first_set(*(F.element_at(_c(radio), F.lit(k)) for k in ("pci", "psc", "bsic")))


def lac_or_tac(identity: Col) -> Column:
    return first_set(*(F.element_at(_c(identity), F.lit(k)) for k in ("tac", "lac")))


def rsrp_display(signal: Col) -> Column:
    return first_set(*(F.element_at(_c(signal), F.lit(k)) for k in ("rsrp_filt", "rxl")))


# Spans and ages of tick counts.
def ticks_to_seconds(delta: Col) -> Column:
    d = _c(delta).cast("long")
    return F.when(d >= 10**9, F.floor(d / 10**9)).when(d >= 10**6, F.floor(d / 10**6)).when(d >= 1000, F.floor(d / 1000)).otherwise(d)


def format_duration(seconds: Col) -> Column:
    s = _c(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r))
        .otherwise(F.format_string("%ds", r))
    )


def format_span(first: Col, last: Col) -> Column:
    """'seen 4m 20s' between two tick counts given as text; '' if they run backwards or are no counts."""
    a, b = _ticks(first), _ticks(last)
    s = ticks_to_seconds(b - a)
    return F.when(a.isNull() | b.isNull() | (b < a), "").when(s < 1, "seen <1s").otherwise(F.concat(F.lit("seen "), format_duration(s)))


def _ticks(text: Col) -> Column:
    return F.when(F.trim(_c(text)).rlike("^[0-9]+$"), F.trim(_c(text)).cast("long"))


def format_age(last: Col, now: Col) -> Column:
    """'12s ago' between tick counts; wall-clock text passes through; '—' if it lies ahead."""
    text = F.trim(_c(last))
    a, b = _ticks(last), _ticks(now)
    s = ticks_to_seconds(b - a)
    return (
        F.when(text == "", "").when(text.rlike("^[0-9]...[-/]..[-/]") | a.isNull() | b.isNull(), text).when(b < a, "—").when(s < 2, "just now")
        .otherwise(F.concat(format_duration(s), F.lit(" ago")))
    )


# BCD identities in binary payloads (offsets count from 0).
def byte_at(payload: Col, at: int) -> Column:
    return F.conv(F.hex(F.substring(_c(payload), at + 1, 1)), 16, 10).cast("int")


def _plmn_of(b0: Column, b1: Column, b2: Column) -> Column:
    low, high = (lambda b: b.bitwiseAND(15)), (lambda b: F.shiftright(b, 4).bitwiseAND(15))
    mcc = low(b0) * 100 + high(b0) * 10 + low(b1)
    two = low(b2) * 10 + high(b2)
    third = high(b1)
    mnc = F.when(third == 15, two).otherwise(two * 10 + third)
    legal = (low(b0) <= 9) & (high(b0) <= 9) & (low(b1) <= 9) & (low(b2) <= 9) & (high(b2) <= 9) & ((third <= 9) | (third == 15))
    return F.when(legal, F.struct(mcc.alias("mcc"), mnc.alias("mnc")))


def decode_plmn(payload: Col, at: int = 0) -> Column:
    """struct(mcc, mnc) of three BCD bytes; null if a digit is over 9."""
    return _plmn_of(byte_at(payload, at), byte_at(payload, at + 1), byte_at(payload, at + 2))


def decode_lai(payload: Col, at: int = 0) -> Column:
    """struct(mcc, mnc, lac) of five bytes; null if the PLMN is not legal."""
    plmn = decode_plmn(payload, at)
    lac = byte_at(payload, at + 3) * 256 + byte_at(payload, at + 4)
    return F.when(plmn.isNotNull(), F.struct(plmn["mcc"].alias("mcc"), plmn["mnc"].alias("mnc"), lac.alias("lac")))

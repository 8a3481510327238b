"""Packet decoders with bytes of our own: short payloads, unknown versions, nulls, and what the queries do not cover."""

from __future__ import annotations

import struct

import pytest

from aircensus.operators import decode
from aircensus.operators.packets import DECODERS

SCHEMA = "session_id long, seq long, log_code int, payload binary"


def events(spark, *packets):
    rows = [(0, i, code, None if p is None else bytearray(p)) for i, (code, p) in enumerate(packets)]
    found = decode.decode_packets(spark.createDataFrame(rows, SCHEMA)).orderBy("seq", "sub_seq").collect()
    return [{k: v for k, v in r.asDict().items() if v is not None and k not in ("session_id", "sub_seq", "log_code")} for r in found]


def test_short_unknown_and_null_payloads_give_nothing(spark):
    assert len(DECODERS) >= 32
    codes = sorted(DECODERS)
    for payload in (None, b"", b"\x63", b"\x63\x00"):
        assert events(spark, *((code, payload) for code in codes)) == []
    # three bytes are a whole record of one code
    assert events(spark, *((code, b"\x63\x00\x00") for code in codes)) == [{"seq": codes.index(0x507A), "rat": "GSM", "kind": "signal", "rxlev": 6}]


@pytest.mark.parametrize(("code", "version"), [(0xB0C1, 9), (0xB0C2, 9), (0xB0C4, 1), (0xB17F, 3), (0xB180, 6), (0xB193, 2), (0xB197, 7), (0xB114, 1), (0xB0EE, 3), (0x506A, 5), (0x4005, 0xC1)])
def test_unknown_versions_give_nothing(spark, code, version):
    assert events(spark, (code, bytes([version]) + b"\x01" * 80)) == []


def test_gsm_levels_round_towards_zero(spark):
    power = struct.pack("<h", -1001)  # -62.56
    got = events(spark, (0x5075, b"\x00\x00" + struct.pack("<H", 77) + power), (0x506C, bytes(11) + power), (0x506C, bytes(13)), (0x5A7A, b"\x01" + power + b"\x00"), (0x5075, bytes(6)))
    assert got == [{"seq": 0, "rat": "GSM", "kind": "gsm_nb", "freq": 77, "rxlev": -62}, {"seq": 1, "rat": "GSM", "kind": "signal", "rxlev": -62}, {"seq": 3, "rat": "GSM", "kind": "signal", "rxlev": -62}]


def test_plain_measurements_after_a_foreign_subpacket(spark):
    cell = bytes(8) + struct.pack("<H", 210) + bytes(34) + struct.pack("<I", 1440 << 12) + bytes(100)
    body = struct.pack("<II", 1300, 1) + cell
    packet = b"\x01\x03\x00\x00" + struct.pack("<BBH", 0x21, 1, 10) + bytes(6) + struct.pack("<BBH", 0x19, 59, 4 + len(body)) + body
    assert events(spark, (0xB193, packet), (0xB193, packet[:-1])) == [
        {"seq": 0, "rat": "LTE", "kind": "radio", "freq": 1300, "phy": 0}, {"seq": 0, "rat": "LTE", "kind": "meas_nb", "freq": 1300, "phy": 210, "rsrp": -90.0},
    ]


def test_registration_never_carries_the_temporary_identity(spark):
    identity = 0x5A17C3E9
    got = events(spark, (0xB0EE, bytes.fromhex("020300006224100100622410123407") + struct.pack("<I", identity)))
    assert [(g["mcc"], g["mnc"], g["mme_group"], g["mme_code"]) for g in got] == [(264, 12, 0x1234, 7)]
    assert not any(v in (identity, int.from_bytes(struct.pack("<I", identity), "big")) for g in got for v in g.values())


def test_events_with_a_stated_size_and_beyond_the_buffer(spark):
    word = lambda event, kind, brief: struct.pack("<HH", 0, event | kind << 13 | brief << 15)
    got = events(spark, (0, word(1606, 3, 1) + b"\x01\x02" + b"\x01\x04"), (0, word(1606, 3, 0) + bytes(8) + b"\x05\x04"), (0, word(500, 2, 1) + b"\x01\x02\x09"), (0, word(777, 1, 1) + bytes(3)))
    assert got == [{"seq": 0, "rat": "LTE", "kind": "radio", "rrc_state": 4}]


def test_a_journal_line_can_hint_too(spark):
    payload = bytearray(struct.pack("<HH", 0, 500 | 2 << 13 | 1 << 15) + b"\x01\x02" + struct.pack("<H", 91))
    rows = [(0, 1, 0, payload, None), (0, 2, 0, payload, 17), (0, 3, 0, bytearray(b"\x00"), 18), (0, 4, 0, bytearray(b"\x00"), 2000), (0, 5, 0xB0C0, payload, 19)]
    got = decode.surround_hints(spark.createDataFrame(rows, SCHEMA + ", hdr_earfcn int"))
    assert {(r.seq, r.freq) for r in got.collect()} == {(1, 91), (2, 17), (3, 18)}


def test_rrc_headers_of_bad_wrappers_are_null(spark):
    good = struct.pack("<BxxxHHxxBHB", 3, 44, 2525, 5, 1, 0x77)
    far, code, empty = struct.pack("<BxxxHHxxBHB", 3, 504, 2525, 5, 1, 0x77), struct.pack("<BxxxHHxxBHB", 3, 44, 2525, 16, 1, 0x77), good[:13]
    high = struct.pack("<BxxxHIxxBIHB", 8, 44, 0xFFFFFFFF, 5, 0, 1, 0x77)
    rows = [(0, i, 0xB0C0, None if p is None else bytearray(p)) for i, p in enumerate((good, b"\x04" + good, far, code, empty, high, b"", None))]
    got = decode.decode_rrc_header(spark.createDataFrame(rows, SCHEMA)).orderBy("seq").collect()
    assert [(r.version, r.pci, r.earfcn, r.pdu, r.channel, r.body) for r in got[:2]] == [(3, 44, 2525, 5, "DL_CCCH", b"\x77")] * 2
    assert all(r.version is None and r.channel is None and r.body is None for r in got[2:])

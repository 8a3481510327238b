"""GSM packets (C7) and modem events (C10).  Codes of phones with two cards carry one more byte in front."""

from __future__ import annotations

import numpy as np

from .packets import ABSENT, at, entries, le, plmn, register_decoder, signed, where_or_absent

# fixed values: message types of system information
SI3, SI4, SI6 = 0x1B, 0x1C, 0x1E
SYSTEM_INFORMATION = (0x19, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E)


def gsm(code: int, dual: int):
    """Register a decoder for a code and its twin of dual-card phones."""

    def add(fn):
        register_decoder(code, "GSM")(fn)
        register_decoder(dual, "GSM")(lambda b, n: fn(b[:, 1:], np.maximum(n - 1, 0)))
        return fn

    return add


def _level(raw: np.ndarray) -> np.ndarray:
    """Sixteenths of a dB to whole dB, towards zero."""
    return np.trunc(signed(raw, 16) / 16).astype(np.int64)


def _identity(b, where) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    legal, mcc, mnc = plmn(b, where)
    return legal, {"mcc": mcc, "mnc": mnc, "tac": at(b, np.asarray(where) + 3, 2, big=True)}


@gsm(0x5134, 0x5B34)
def _cell_info(b, n):
    """Serving cell: channel and colour codes always, identity if it is legal."""
    word, size = le(b, 0, 2), n >= 13
    freq, bcc, ncc, cid = word & 0xFFF, le(b, 2, 1) & 7, le(b, 3, 1) & 7, le(b, 4, 2)
    legal, who = _identity(b, 6)
    ok = size & (freq <= 1023)
    key = {"freq": freq, "phy": ncc << 3 | bcc}
    return [("passport", ok & legal & (cid != 0), {**key, **who, "cid": cid}), ("radio", ok, {**key, "band": word >> 12, "ncc_permitted": le(b, 12, 1)}), ("serving", ok, key)]


@gsm(0x512F, 0x5B2F)
def _system_information(b, n):
    """System information 3, 4 and 6, with the full header or with the short one that starts at the cell id."""
    second, third = le(b, 1, 1), le(b, 2, 1)
    full = np.isin(second, SYSTEM_INFORMATION)
    kind = np.where(full, second, third)
    ok = (n >= 6) & np.isin(kind, SYSTEM_INFORMATION)
    body = np.where(full, np.minimum(third, n - 3), n - 3)  # octets from the third on
    base = np.where(full, 3, 0)  # place of the octet that a full message would have first
    length = body + np.where(full, 0, 3)
    cid = at(b, base + 3, 2, big=True)
    legal, who = _identity(b, base + 5)
    known = ok & legal & (cid != 0)
    si3 = known & (kind == SI3) & np.where(full, body >= 19, body >= 7)
    si6 = known & (kind == SI6) & np.where(full, body >= 10, body >= 7)
    area, where = _identity(b, base + 3)
    si4 = ok & area & (kind == SI4) & np.where(full, body >= 10, body >= 5)
    octet = lambda i: at(b, base + i, 1)
    # rest octets of SI3: a flag, one unused bit, offset (6), temporary offset (3), penalty (5)
    reselect = (length >= 21) & (octet(19) >> 7 == 1)
    si3_radio = {
        "max_tx": octet(14) & 31, "rxlev_min": octet(15) & 63, "ncc_permitted": np.where(length >= 19, octet(18), 255),
        "reselect_offset": where_or_absent(reselect, octet(19) & 63), "temporary_offset": where_or_absent(reselect, octet(20) >> 5), "penalty_time": where_or_absent(reselect, octet(20) & 31),
    }
    si4_radio = {"max_tx": np.where(full, octet(10), octet(8)) & 31, "rxlev_min": np.where(full, octet(11), octet(9)) & 63}
    return [
        ("passport", si3 | si6, {**who, "cid": cid}), ("radio", si3 & (length >= 16), si3_radio),
        ("passport", si4, where), ("radio", si4 & np.where(full, body >= 12, body >= 7), si4_radio),
    ]


@gsm(0x5071, 0x5A71)
def _surround(b, n):
    """Up to 64 neighbours of twelve bytes."""
    count, out = le(b, 0, 1), []
    for i in entries(count, 64):
        off = 1 + 12 * i
        freq = le(b, off, 2) & 0xFFF
        code = where_or_absent(le(b, off + 4, 1) == 1, le(b, off + 5, 1))
        out.append(("gsm_nb", (i < count) & (off + 12 <= n) & (freq <= 1023), {"freq": freq, "phy": code, "rxlev": _level(le(b, off + 2, 2))}))
    return out


@gsm(0x507B, 0x5A7B)
def _neighbour_levels(b, n):
    """Up to 64 neighbours of four bytes, without a code."""
    count, out = le(b, 0, 1), []
    for i in entries(count, 64):
        off = 1 + 4 * i
        freq = le(b, off, 2) & 0xFFF
        out.append(("gsm_nb", (i < count) & (off + 4 <= n) & (freq <= 1023), {"freq": freq, "rxlev": _level(le(b, off + 2, 2))}))
    return out


@gsm(0x5075, 0x5A75)
def _neighbour_found(b, n):
    freq = le(b, 2, 2) & 0xFFF
    return [("gsm_nb", (n >= 6) & (freq >= 1) & (freq <= 1023), {"freq": freq, "rxlev": _level(le(b, 4, 2))})]


@gsm(0x506C, 0x5A6C)
def _burst(b, n):
    """Level of the serving cell; a raw zero means that nothing was measured."""
    raw = le(b, 11, 2)
    return [("signal", (n >= 13) & (raw != 0), {"rxlev": _level(raw)})]


@register_decoder(0x506A, "GSM")
def _new_burst(b, n):
    """Version 4: the measured cell as a neighbour, and the serving signal with its SNR where the record is long enough."""
    freq, level = le(b, 6, 2) & 0xFFF, _level(le(b, 12, 2))
    ok = (n >= 14) & (b[:, 0] == 4) & (freq >= 1) & (freq <= 1023)
    return [("gsm_nb", ok, {"freq": freq, "rxlev": level}), ("signal", ok & (n >= 24), {"rxlev": level, "snr": signed(le(b, 22, 2), 16).astype(float)})]


@gsm(0x507A, 0x5A7A)
def _serving_level(b, n):
    return [("signal", n >= 3, {"rxlev": _level(le(b, 0, 2))})]


@register_decoder(0x0000, "LTE")
def _modem_event(b, n):
    """Event 500 hints at a GSM channel, event 1606 tells the RRC state (0..7) of the serving LTE cell.

    Two length bytes, the event word (id, kind of payload, short time), a time of
    eight or two bytes, then a payload of one, two or a stated number of bytes.
    """
    word = le(b, 2, 2)
    event, kind = word & 0xFFF, word >> 13 & 3
    start = np.where(word >> 15 == 1, 6, 12)
    ok = (n >= 4) & (start <= n)
    stated = (kind == 3) & (start < n)
    size = np.where(stated, at(b, start, 1), np.where(kind == 3, 0, kind))
    start = start + stated
    ok = ok & (start + size <= n)
    hint, state = at(b, start, 2) & 0x3FF, at(b, start, 1)
    return [
        ("hint", ok & (event == 500) & (size >= 2) & (hint != 0), {"freq": hint, "phy": np.full(len(b), ABSENT)}, "GSM"),
        ("radio", ok & (event == 1606) & (size >= 1) & (state <= 7), {"rrc_state": state}),
    ]

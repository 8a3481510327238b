"""LTE packets: identity and acquisition (C4), measurements (C5), timing and registration."""

from __future__ import annotations

import numpy as np

from .packets import at, entries, le, pick, plmn, register_decoder, subpackets, where_or_absent


def _channel(freq):
    return (freq >= 1) & (freq <= 262143)


def _code(pci):
    return (pci >= 1) & (pci <= 503)


def _heard(rsrp):
    return (rsrp >= -150) & (rsrp <= -40)


def _open(low, values, high):
    """Levels strictly above ``low`` and up to ``high``."""
    return where_or_absent((values > low) & (values <= high), values)


def unpack_pci(word: np.ndarray) -> np.ndarray:
    """PCI of packed words: the packing that the word does not refute, low bits if both stand."""
    low, high = word & 511, (word >> 7) & 511
    return np.where(~_code(low) & _code(high), high, np.where(_code(low), low, high))


@register_decoder(0xB0C2, "LTE")
def _identity(b, n):
    """Serving cell info, versions 2 and 3: radio if the key is legal, passport if the identity is."""
    v = b[:, 0]
    ok = ((v == 2) & (n >= 25)) | ((v == 3) & (n >= 29))
    wide = {2: 2, 3: 4}
    field = lambda at2, s2, at3, s3: pick(v, {2: le(b, 1 + at2, s2), 3: le(b, 1 + at3, s3)})
    pci = le(b, 1, 2)
    out = {
        "phy": pci, "freq": field(2, wide[2], 2, wide[3]), "ul_freq": field(4, 2, 6, 4), "band": field(14, 4, 18, 4), "cid": field(8, 4, 12, 4),
        "tac": field(12, 2, 16, 2), "mcc": field(18, 2, 22, 2), "mnc": field(21, 2, 25, 2),
    }
    key = ok & _channel(out["freq"]) & (pci <= 503)
    known = key & (out["cid"] >= 1) & (out["cid"] <= 0x0FFFFFFF) & (out["tac"] >= 1) & (out["tac"] <= 0xFFFE) & (out["mcc"] >= 100) & (out["mcc"] <= 999)
    radio = {k: out[k] for k in ("phy", "freq", "ul_freq", "band")}
    return [("radio", key, radio), ("passport", known, {k: out[k] for k in ("phy", "freq", "cid", "tac", "mcc", "mnc")})]


@register_decoder(0xB0C1, "LTE")
def _master_information(b, n):
    """Versions 1 and 2: key, frame number and bandwidth in MHz."""
    v = b[:, 0]
    ok = ((v == 1) & (n >= 9)) | ((v == 2) & (n >= 11))
    pci, freq, sfn = le(b, 1, 2), pick(v, {1: le(b, 3, 2), 2: le(b, 3, 4)}), pick(v, {1: le(b, 5, 2), 2: le(b, 7, 2)})
    blocks = pick(v, {1: le(b, 8, 1), 2: le(b, 10, 1)})
    mhz = pick(blocks, {k: np.full(len(b), m) for k, m in {6: 1, 15: 3, 25: 5, 50: 10, 75: 15, 100: 20}.items()})
    return [("radio", ok & (pci <= 503) & _channel(freq), {"freq": freq, "phy": pci, "sfn": sfn, "bandwidth": where_or_absent(mhz > 0, mhz)})]


@register_decoder(0xB176, "LTE")
def _acquisition(b, n):
    freq, pci = le(b, 4, 4), le(b, 20, 2)
    return [("radio", (n >= 22) & _channel(freq) & _code(pci), {"freq": freq, "phy": pci})]


@register_decoder(0xB0C4, "LTE")
def _operator_search(b, n):
    """Search results, version 2: entries of eight bytes up to the first bad one; kind 3 names a channel, on which code 0 gets the PLMN."""
    alive, zero, out = (n >= 16) & (b[:, 0] == 2), np.zeros(len(b), np.int64), []
    for off in range(8, b.shape[1] - 7, 8):
        legal, mcc, mnc = plmn(b, off + 1)
        kind, freq = le(b, off, 1), le(b, off + 4, 4)
        alive = alive & (off + 8 <= n) & ((kind == 2) | (kind == 3)) & legal
        has = alive & (kind == 3) & _channel(freq)
        out += [("radio", has, {"freq": freq, "phy": zero}), ("passport", has, {"freq": freq, "phy": zero, "mcc": mcc, "mnc": mnc})]
        if not alive.any():
            break
    return out


@register_decoder(0xB17F, "LTE")
def _serving_measurement(b, n):
    """Serving measurement, versions 4 and 5; an RSRP outside -150..-40 gives nothing, a bad key leaves the signal without one."""
    v = b[:, 0]
    ok = ((v == 4) & (n >= 24)) | ((v == 5) & (n >= 28))
    freq = pick(v, {4: le(b, 4, 2), 5: le(b, 4, 4)})
    pci = unpack_pci(pick(v, {4: le(b, 6, 2), 5: le(b, 8, 2)}))
    rsrp = (pick(v, {4: le(b, 8, 4), 5: le(b, 12, 4)}) & 0xFFF) / 16 - 180
    rsrq = (pick(v, {4: le(b, 16, 4), 5: le(b, 20, 4)}) >> 22) / 16 - 30
    rssi = (pick(v, {4: le(b, 20, 4), 5: le(b, 24, 4)}) >> 11 & 0x7FF) / 16 - 110
    good = ok & _heard(rsrp)
    keyed = good & _channel(freq) & _code(pci)
    key = {"freq": where_or_absent(keyed, freq), "phy": where_or_absent(keyed, pci)}
    return [("radio", keyed, key), ("signal", good, {**key, "rsrp": rsrp, "rsrq": rsrq, "rssi": rssi}), ("serving", good, key)]


@register_decoder(0xB197, "LTE")
def _serving_info(b, n):
    """Serving cell, versions 1 and 2: key, frame number, and that it serves."""
    v = b[:, 0]
    ok = ((v == 1) & (n >= 8)) | ((v == 2) & (n >= 12))
    freq, pci, sfn = pick(v, {1: le(b, 4, 2), 2: le(b, 4, 4)}), unpack_pci(pick(v, {1: le(b, 6, 2), 2: le(b, 8, 2)})), le(b, 2, 2)
    good, key = ok & _channel(freq) & (pci <= 503), {"freq": freq, "phy": pci}
    return [("radio", good, {**key, "sfn": where_or_absent(sfn <= 1023, sfn)}), ("serving", good, key)]


@register_decoder(0xB180, "LTE")
def _neighbour_measurement(b, n):
    """Neighbours on one channel, versions 4 and 5: at most sixteen records of 32 bytes."""
    v = b[:, 0]
    ok = ((v == 4) & (n >= 8)) | ((v == 5) & (n >= 12))
    freq, first = pick(v, {4: le(b, 4, 2), 5: le(b, 4, 4)}), np.where(v == 4, 8, 12)
    count = np.minimum(pick(v, {4: le(b, 6, 2), 5: le(b, 8, 4)}) >> 6, 16)
    out = []
    for i in entries(np.where(ok, count, 0), 16):
        off = first + 32 * i
        word = at(b, off, 4)
        pci, rsrp, rsrq = word >> 23 & 0x1FF, (word & 0xFFF) / 16 - 180, (at(b, off + 8, 4) >> 12 & 0x3FF) / 16 - 30
        out.append(("meas_nb", ok & (i < count) & (off + 12 <= n) & (pci <= 503) & _heard(rsrp), {"freq": freq, "phy": pci, "rsrp": rsrp, "rsrq": rsrq}))
    return out


@register_decoder(0xB193, "LTE")
def _measurement_report(b, n):
    """Subpackets 0x19: versions 48 and 50 give radio, signal and neighbour rows of each cell, version 59 neighbours only.

    At most eight cells a subpacket; a cell without a legal code or RSRP gives
    nothing.  Levels out of range are absent.
    """
    out, zero = [], np.zeros(len(b), np.int64)
    count = np.where((n >= 8) & (b[:, 0] == 1), le(b, 1, 1), 0)
    for live, ident, version, body, size in subpackets(b, n, count):
        end = body + size
        short = live & (ident == 0x19) & (size >= 8)
        rich, plain = short & np.isin(version, (48, 50)), short & (version == 59)
        freq = at(b, body, 4)
        legal = _channel(freq)
        cells = np.where(rich, at(b, body + 4, 2), np.where(plain, at(b, body + 4, 4), 0))
        out.append(("radio", (rich | plain) & legal, {"freq": freq, "phy": zero}))
        for i in entries(cells, 8):
            cell = body + np.where(rich, 12 + 140 * i, 8 + 148 * i)
            word = at(b, cell + np.where(rich, 0, 8), 2)
            pci = unpack_pci(word)
            both = at(b, cell + 36, 4)
            rsrp = np.where(rich, both & 0xFFF, at(b, cell + 44, 4) >> 12 & 0xFFF) / 16 - 180
            has = (i < cells) & (cell + np.where(rich, 96, 48) <= end) & _code(pci) & _heard(rsrp)
            filtered = (both >> 12 & 0xFFF) / 16 - 180
            rsrq = np.maximum(at(b, cell + 40, 2) & 0x1FF, at(b, cell + 44, 2) & 0x1FF) / 16 - 30
            rssi = at(b, cell + 60, 2) / 16 - 110
            snr_word = at(b, cell + 92, 4)
            snr = np.maximum(snr_word & 0x1FF, snr_word >> 9 & 0x1FF) * 0.1 - 20
            levels = {
                "rsrp": rsrp, "rsrp_filtered": where_or_absent(_heard(filtered), filtered), "rsrq": _open(-30, rsrq, -1), "rsrq_filtered": _open(-30, (at(b, cell + 48, 4) >> 20 & 0x1FF) / 16 - 30, -1),
                "rssi": where_or_absent((rssi > -120) & (rssi < -20), rssi), "snr": where_or_absent((snr > -20) & (snr < 40), snr),
            }
            key = {"freq": where_or_absent(legal, freq), "phy": pci}
            nb = {k: np.where(rich, v, v if k == "rsrp" else np.nan) for k, v in levels.items()}
            full = rich & has
            out += [
                ("radio", full & legal, {**key, "sfn": at(b, cell + 4, 2) & 0x3FF}), ("signal", full, {**key, **levels}),
                ("serving", full & (word >> 12 & 1 == 1), key), ("meas_nb", (rich | plain) & has, {**key, **nb}),
            ]
    return out


@register_decoder(0xB114, "LTE")
def _timing(b, n):
    """Serving cell timing, version 161: timing advance up to 1282."""
    ta = le(b, 2, 2) >> 1
    return [("radio", (n >= 16) & (b[:, 0] == 161) & (ta <= 1282), {"ta": ta})]


@register_decoder(0xB115, "LTE")
def _detected(b, n):
    """Detected cells on a channel, records of sixteen bytes, at most sixteen; without one the channel alone is told."""
    freq = le(b, 4, 4)
    ok, fit, told = (n >= 8) & _channel(freq), np.maximum(n - 8, 0) // 16, le(b, 1, 1) >> 5
    count = np.minimum(np.where((told == 0) | (told > fit), fit, told), 16)
    out, some = [], np.zeros(len(b), bool)
    for i in entries(np.where(ok, count, 0), 16):
        pci = le(b, 8 + 16 * i + 2, 2) & 0x1FF
        has = ok & (i < count) & _code(pci)
        some = some | has
        out.append(("radio", has, {"freq": freq, "phy": pci}))
    return [*out, ("inter_carriers", ok & ~some, {"freq": freq})]


@register_decoder(0xB0EE, "LTE")
def _registration(b, n):
    """Version 2: registration state, its PLMN and, if a temporary identity is there, the MME; the identity itself is never read."""
    legal, mcc, mnc = plmn(b, 4)
    mme = le(b, 7, 1) != 0
    values = {"emm_state": le(b, 1, 1), "emm_substate": le(b, 2, 1), "mcc": mcc, "mnc": mnc, "mme_group": where_or_absent(mme, at(b, 12, 2, big=True)), "mme_code": where_or_absent(mme, le(b, 14, 1))}
    return [("registration", (n >= 19) & (b[:, 0] == 2) & legal, values)]


# fixed values: first version of a layout, then places of pci, earfcn and its bytes, pdu, declared length, first body byte
RRC_LAYOUTS = ((30, 6, 8, 4, 14, 19, 24), (25, 6, 8, 4, 14, 19, 21), (8, 4, 6, 4, 12, 17, 19), (5, 4, 6, 2, 10, 15, 17), (2, 4, 6, 2, 10, 11, 13))
RRC_LONGEST = 24


def _rrc_fields(b, n):
    version = le(b, 0, 1)
    layout = np.select([version >= first for first, *_ in RRC_LAYOUTS], range(len(RRC_LAYOUTS)), -1)
    pci, freq, wide, pdu, length, head = (pick(layout, {k: np.full(len(b), row[i]) for k, row in enumerate(RRC_LAYOUTS)}) for i in range(1, 7))
    out = {
        "version": version, "pci": at(b, pci, 2), "earfcn": np.where(wide == 4, at(b, freq, 4), at(b, freq, 2)), "pdu": at(b, pdu, 1), "pdu_len": at(b, length, 2),
        "segment_id": where_or_absent(version >= 30, le(b, 23, 1)), "head": head,
    }
    sane = ((out["pdu"] >= 1) & (out["pdu"] <= 15)) | ((out["pdu"] >= 45) & (out["pdu"] <= 61))
    return (layout >= 0) & (n > head) & sane & (out["pci"] <= 503) & (out["earfcn"] <= 262143) & (out["pdu_len"] <= n - head + 64), out


def rrc_header(b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(rows that decode, fields) of RRC wrappers; one flag byte of at most 4 in front is passed over if nothing decodes with it."""
    ok, first = _rrc_fields(b, n)
    later, second = _rrc_fields(b[:, 1:], n - 1)
    later = later & ~ok & (n > 2) & (b[:, 0] <= 4)
    second["head"] = second["head"] + 1
    return ok | later, {k: np.where(later, second[k], v) for k, v in first.items()}

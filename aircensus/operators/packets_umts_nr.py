"""WCDMA (C8) and NR (C9) packets."""

from __future__ import annotations

import numpy as np

from .packets import at, entries, le, pick, register_decoder, signed, subpackets, where_or_absent


def _wcdma_identity(b, n, shift):
    """Cell identity of 32 bytes."""
    digits = lambda where: [le(b, where + i, 1) for i in range(3)]

    def number(d):
        out, open_ = np.zeros(len(b), np.int64), np.ones(len(b), bool)
        for x in d:
            open_ = open_ & ((x & 15) != 15)
            out = np.where(open_, out * 10 + (x & 15), out)
        return out

    out = {"ul_freq": le(b, 0, 4), "freq": le(b, 4, 4), "cid": le(b, 8, 4) & 0x0FFFFFFF, "mcc": number(digits(18)), "mnc": number(digits(21)), "tac": le(b, 24, 4) & 0xFFFF}
    out["phy"] = le(b, 16, 2) >> shift
    good = (n >= 32) & (out["mcc"] >= 1) & (out["mcc"] <= 999) & (out["phy"] <= 511) & (out["freq"] >= 1) & (out["freq"] <= 16383)
    return [("passport", good, out), ("radio", good, {k: out[k] for k in ("freq", "phy", "ul_freq")}), ("serving", good, {k: out[k] for k in ("freq", "phy")})]


@register_decoder(0x4027, "WCDMA")
def _wcdma_cell_id(b, n):
    """The PSC lies in the upper twelve bits."""
    return _wcdma_identity(b, n, 4)


@register_decoder(0x4127, "WCDMA")
def _wcdma_serving(b, n):
    return _wcdma_identity(b, n, 0)


@register_decoder(0x4005, "WCDMA")
def _wcdma_ranks(b, n):
    """Reselection ranks: the first legal 3G cell serves, the others are neighbours, GSM cells follow.

    RSCP is the signed byte less 21, Ec/Io half of one towards zero, both clipped.
    """
    # fixed values by layout version: first entry, bytes of a 3G entry, bytes of a 2G entry
    layouts = {0: (2, 10, 7), 1: (2, 11, 8), 2: (7, 16, 13)}
    layout = le(b, 0, 1) >> 6
    first, wide, narrow = (pick(layout, {v: np.full(len(b), sizes[i]) for v, sizes in layouts.items()}) for i in range(3))
    ok = (n >= 4) & (layout <= 2)
    n3, n2 = np.minimum(le(b, 0, 1) & 63, 16), np.minimum(le(b, 1, 1) & 63, 16)
    out, served = [], np.zeros(len(b), bool)
    for i in entries(n3, 16):
        off = first + wide * i
        freq, psc = at(b, off, 2), at(b, off + 2, 2)
        has = ok & (i < n3) & (off + 8 <= n) & (psc <= 511) & (freq >= 1) & (freq <= 16383)
        key = {"freq": freq, "phy": psc}
        levels = {"rscp": np.clip(signed(at(b, off + 4, 1), 8) - 21, -140, 0), "ecio": np.clip(np.trunc(signed(at(b, off + 7, 1), 8) / 2).astype(np.int64), -50, 0)}
        serving = has & ~served
        out += [("radio", serving, key), ("signal", serving, {**key, **levels}), ("serving", serving, key), ("wcdma_nb", has & served, {**key, **levels})]
        served = served | has
    for i in entries(n2, 16):
        off = first + wide * n3 + narrow * i
        freq = at(b, off, 2) & 0xFFF
        has = ok & (i < n2) & (off + 5 <= n) & (freq >= 1) & (freq <= 1023)
        out.append(("gsm_nb", has, {"freq": freq, "phy": at(b, off + 2, 1), "rxlev": signed(at(b, off + 3, 1), 8)}, "GSM"))
    return out


@register_decoder(0x4111, "WCDMA")
def _wcdma_active_set(b, n):
    """Codes of the active set on one channel, at most sixteen."""
    freq, count = le(b, 1, 2), le(b, 3, 1)
    ok = (n >= 4) & (freq >= 1) & (freq <= 16383)
    out = [("radio", ok, {"freq": freq, "phy": np.zeros(len(b), np.int64)})]
    for i in entries(count, 16):
        off = 4 + 7 * i
        psc = le(b, off, 2)
        out.append(("wcdma_nb", ok & (i < count) & (off + 2 <= n) & (psc <= 511), {"freq": freq, "phy": psc}))
    return out


def _nr_key(freq, pci):
    return (pci <= 1007) & (freq >= 1) & (freq <= 3279165)


@register_decoder(0xB822, "NR")
def _nr_mib(b, n):
    """Master information: PCI and channel; frame number and spacing in the two known releases."""
    pci, freq = le(b, 4, 2), le(b, 6, 4)
    release = le(b, 2, 2) << 16 | le(b, 0, 2)
    old, new = release == 0x00003, (release == 0x20000) & (n >= 15)
    code = np.where(old, le(b, 10, 4) >> 30, le(b, 10, 5) >> 31 & 3)
    extra = {"sfn": where_or_absent(old | new, le(b, 10, 4) & 0x3FF), "scs": where_or_absent(old | new, 15 << code)}
    return [("radio", (n >= 14) & _nr_key(freq, pci), {"freq": freq, "phy": pci, **extra})]


@register_decoder(0xB823, "NR")
def _nr_serving_cell(b, n):
    """Serving cell: radio if the key is legal, passport if the identity is; three layouts by release."""
    # fixed values by release (major << 16 | minor): length, then places of pci, two cell ids, channel, uplink, bandwidth, mcc, mnc, tac, band
    late = (49, 7, 9, 29, 17, 21, 25, 37, 40, 43, 47)
    layouts = {0x00004: (38, 4, 18, 18, 6, 10, 14, 26, 29, 32, 36), 0x30000: (46, 4, 6, 26, 14, 18, 22, 34, 37, 40, 44), 0x30002: late, 0x30003: late}
    release = le(b, 2, 2) << 16 | le(b, 0, 2)
    where = [pick(release, {v: np.full(len(b), places[i]) for v, places in layouts.items()}) for i in range(11)]
    pci, global_id, own_id = at(b, where[1], 2), at(b, where[2], 8), at(b, where[3], 8)
    freq, ul, bandwidth, mcc, mnc, tac, band = (at(b, where[i], size) for i, size in zip(range(4, 11), (4, 4, 2, 2, 2, 4, 2)))
    cid = np.where(own_id != 0, own_id, global_id)
    ok = np.isin(release, list(layouts)) & (n >= where[0]) & _nr_key(freq, pci)
    key = {"freq": freq, "phy": pci}
    known = ok & (cid != 0) & (tac != 0) & (mcc >= 100) & (mcc <= 999)
    return [("radio", ok, {**key, "ul_freq": ul, "bandwidth": np.minimum(bandwidth, 255), "band": band}), ("passport", known, {**key, "cid": cid, "tac": tac, "mcc": mcc, "mnc": mnc})]


def _nr_levels(word):
    return (word & 0xFFF) / 16 - 30, (word >> 12 & 0x3FF) / 16 - 20


@register_decoder(0xB992, "NR")
def _nr_serving_measurement(b, n):
    """Signal of the serving cell of each subpacket; RSRQ and SINR where the subpacket is long enough."""
    out = []
    for live, _, _, body, size in subpackets(b, n, le(b, 2, 1)):
        freq, pci = at(b, body, 3), at(b, body + 4, 2) & 0x3FF
        has = live & (n >= 8) & (size >= 20) & (pci <= 1007) & (freq <= 3279165)
        rsrq, snr = _nr_levels(at(b, body + 16, 4))
        key = {"freq": freq, "phy": pci}
        out += [("signal", has, {**key, "rsrp": (at(b, body + 12, 4) & 0xFFF) / 16 - 180, "rsrq": where_or_absent(size >= 24, rsrq), "snr": where_or_absent(size >= 24, snr)}), ("serving", has, key)]
    return out


@register_decoder(0xB97F, "NR")
def _nr_neighbours(b, n):
    """Neighbours of each subpacket, each with its strongest beam."""
    out = []
    for live, _, _, body, size in subpackets(b, n, le(b, 2, 1)):
        freq, count = at(b, body, 3), at(b, body + 4, 1) & 15
        live = live & (n >= 8) & (size >= 8) & (freq <= 3279165)
        off = np.full(len(b), 8)
        for i in entries(np.where(live, count, 0), 15):
            has = live & (i < count) & (off + 4 <= size)
            word = at(b, body + off, 4)
            pci, beams = word & 0x3FF, np.where(has, word >> 10 & 15, 0)
            off = off + np.where(has, 4, 0)
            legal = has & (pci <= 1007)
            rsrp, rsrq, snr = np.full(len(b), -180.0), np.zeros(len(b)), np.zeros(len(b))
            for beam in range(int(beams.max(initial=0))):
                heard = legal & (beam < beams) & (off + 8 <= size)
                level = (at(b, body + off, 4) >> 10 & 0xFFF) / 16 - 180
                quality, noise = _nr_levels(at(b, body + off + 4, 4))
                better = heard & (level > rsrp)
                rsrp, rsrq, snr = np.where(better, level, rsrp), np.where(better, quality, rsrq), np.where(better, noise, snr)
                off = off + np.where(heard | (has & ~legal & (beam < beams)), 8, 0)
            out.append(("meas_nb", legal & (rsrp > -180), {"freq": freq, "phy": pci, "rsrp": rsrp, "rsrq": rsrq, "snr": snr}))
    return out

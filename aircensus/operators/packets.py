"""What the packet decoders share: the registry of decoders (L1) and fields of byte matrices.

A decoder takes all payloads of one log code of an Arrow batch as a zero-padded
byte matrix with the true lengths and gives items ``(kind, rows that have it,
{column: values of all rows})``, or the same with a RAT of its own at the end.
The order of the items is the order of the events of a packet.  Decoders fail
closed: an unknown version or a short payload gives no event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

NUMBERS = (
    "freq", "phy", "ul_freq", "band", "mcc", "mnc", "tac", "cid", "ta", "sfn", "bandwidth", "scs", "rrc_state", "emm_state", "emm_substate", "mme_group", "mme_code",
    "rxlev", "rscp", "ecio", "rxlev_min", "max_tx", "ncc_permitted", "reselect_offset", "temporary_offset", "penalty_time",
)
LEVELS = ("rsrp", "rsrq", "rssi", "rsrp_filtered", "rsrq_filtered", "snr")
ABSENT = np.iinfo(np.int64).min  # a whole number that a row does not have; levels use NaN

Decoder = Callable[[np.ndarray, np.ndarray], list[tuple]]
DECODERS: dict[int, tuple[str, Decoder]] = {}


def register_decoder(codes: int | tuple[int, ...], rat: str):
    """L1: a decoder for some codes; the first registered for a code wins."""

    def add(fn: Decoder) -> Decoder:
        for code in (codes,) if isinstance(codes, int) else codes:
            DECODERS.setdefault(code, (rat, fn))
        return fn

    return add


def byte_matrix(payloads: pa.Array) -> np.ndarray:
    """Payloads as rows of bytes, zero-padded to the longest and at least four wide; null is empty."""
    held = payloads.cast(pa.large_binary()).fill_null(b"") if len(payloads) else payloads.cast(pa.large_binary())
    _, offsets, data = held.buffers()
    at = np.frombuffer(offsets, np.int64)[held.offset : held.offset + len(held) + 1]
    sizes = np.diff(at)
    b = np.zeros((len(held), max(4, int(sizes.max(initial=0)))), dtype=np.uint8)
    if data is not None and len(held):
        b[np.arange(b.shape[1]) < sizes[:, None]] = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return b


#: Bytes of a matrix at most, but for one payload.
MATRIX = 1 << 24


def length_classes(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in groups of like length whose padded matrix stays under ``MATRIX`` bytes, so one long payload does not widen the others."""
    order = np.argsort(sizes, kind="stable")
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and sizes[order[hi]] <= max(64, 2 * sizes[order[lo]]) and (hi + 1 - lo) * int(sizes[order[hi]]) <= MATRIX:
            hi += 1
        yield np.sort(order[lo:hi])
        lo = hi


def at(b: np.ndarray, where: np.ndarray | int, size: int, big: bool = False) -> np.ndarray:
    """Unsigned number of ``size`` bytes at a place of each row, which may differ by row; bytes beyond the matrix are zero."""
    where = np.broadcast_to(np.asarray(where, dtype=np.int64), len(b))
    out = np.zeros(len(b), dtype=np.int64)
    for i in range(size):
        place = where + i
        inside = (place >= 0) & (place < b.shape[1])
        byte = np.where(inside, b[np.arange(len(b)), np.where(inside, place, 0)], 0).astype(np.int64)
        out = (out << 8 | byte) if big else out | byte << (8 * i)
    return out


def le(b: np.ndarray, where: int, size: int) -> np.ndarray:
    """Little-endian unsigned number at a fixed place of every row."""
    return at(b, where, size)


def signed(values: np.ndarray, bits: int) -> np.ndarray:
    return np.where(values >> (bits - 1) & 1, values - (1 << bits), values)


def pick(version: np.ndarray, choices: dict[int, np.ndarray]) -> np.ndarray:
    out = np.zeros(len(version), dtype=np.int64)
    for v, values in choices.items():
        out = np.where(version == v, values, out)
    return out


def where_or_absent(ok: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values of the rows that are ok, absent elsewhere."""
    return np.where(ok, values, np.nan if values.dtype.kind == "f" else ABSENT)


def plmn(b: np.ndarray, where: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(legal, mcc, mnc) of three bytes of swapped digits; 15 in the third MNC digit means that there are two."""
    low = [at(b, np.asarray(where) + i, 1) & 15 for i in range(3)]
    high = [at(b, np.asarray(where) + i, 1) >> 4 for i in range(3)]
    two = high[1] == 15
    mcc = low[0] * 100 + high[0] * 10 + low[1]
    mnc = np.where(two, low[2] * 10 + high[2], low[2] * 100 + high[2] * 10 + high[1])
    digits = (low[0] <= 9) & (high[0] <= 9) & (low[1] <= 9) & (low[2] <= 9) & (high[2] <= 9) & (two | (high[1] <= 9))
    return digits & (mcc >= 100), mcc, mnc


def subpackets(b: np.ndarray, n: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows that have it, id, version, place of the body, its size) of the first, second, ... subpacket; a bad size ends a row."""
    pos, live, done = np.full(len(b), 4), np.ones(len(b), bool), 0
    while True:
        size = at(b, pos + 2, 2)
        live = live & (done < count) & (pos + 4 <= n) & (size >= 4) & (pos + size <= n)
        if not live.any():
            return
        yield live, at(b, pos, 1), at(b, pos + 1, 1), pos + 4, size - 4
        pos, done = np.where(live, pos + size, pos), done + 1


def entries(count: np.ndarray, most: int) -> range:
    """Numbers of the entries that some row has, at most ``most``."""
    return range(min(int(count.max(initial=0)), most))

"""Vectorised text primitives for Arrow batches, shared by the operators.

A *chunk* is a run of documents whose bytes lie in one uint8 array ``data``;
document ``d`` owns ``data[bounds[d]:bounds[d + 1]]``.  Chunks are cut at about
``CHUNK`` bytes, so the temporaries of a task stay at some tens of MB however
large the Arrow batches are; a longer document makes a chunk of its own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_MUL = np.array(
    [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD],
    dtype=np.uint64,
)
_powers: dict[str, np.ndarray] = {}

#: ASCII white space of the word rules that split at [\x20\x09-\x0D]+.
SPACE_LUT = np.zeros(256, dtype=bool)
SPACE_LUT[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of words under [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM_LUT = np.zeros(256, dtype=bool)
ALNUM_LUT[0x30:0x3A] = True
ALNUM_LUT[0x61:0x7B] = True
ALNUM_LUT[0x80:] = True
LOWER_LUT = np.arange(256, dtype=np.uint8)
LOWER_LUT[0x41:0x5B] += 32

#: The same word rules for Python strings.
SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * _MUL[0]
    x = (x ^ (x >> np.uint64(27))) * _MUL[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """P**i (or P**-i) modulo 2**64 for i < n."""
    key = "inv" if inverse else "pow"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, _PINV if inverse else _P, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[key] = have
    return have[:n]


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK):
    """Yield (first row, data, bounds) over a string column; nulls are empty texts."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row = 0
    for part in parts:
        part = part.cast(pa.large_binary())
        if part.null_count:
            part = part.fill_null(b"")
        n = len(part)
        if n:
            _, off, raw = part.buffers()
            offsets = np.frombuffer(off, dtype=np.int64)[part.offset : part.offset + n + 1]
            data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
            lo = 0
            while lo < n:
                hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
                hi = min(max(hi, lo + 1), n)
                yield row + lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                lo = hi
        row += n


def words(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray):
    """(start, end) byte positions of the words, and for each document the index of its first word."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = is_word[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    before[inner] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds, side="left")


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: C[j] - C[i] depends on data[i:j] and i."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for many spans at once."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), True)[starts] + (ends - starts).astype(np.uint64) * _MUL[2])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n items from the items' hashes (len(h) - n + 1 values)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = np.full(size, n, dtype=np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + size]) * _MUL[i % 5] + np.uint64(2 * i + 1)
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for every full window, by doubling."""
    if len(x) < w:
        return x[:0]
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    return x


def single_spaced(data: np.ndarray, bounds: np.ndarray):
    """Bytes with each run of white space as one space, and bounds to match.

    Words keep their bytes; white space at a document's start goes, at its end
    one space may stay.
    """
    space = SPACE_LUT[data]
    keep = np.ones(len(data), dtype=bool)
    if len(data):
        keep[1:] = ~(space[1:] & space[:-1])
        firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
        keep[firsts] = ~space[firsts]
        at = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(keep, out=at[1:])
        bounds = at[bounds]
    out = data[keep]
    out[SPACE_LUT[out]] = 0x20
    return out, bounds

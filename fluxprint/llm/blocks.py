"""Vectorised text kernels for Arrow batches: bytes, words, shingles and their hashes.

Everything here works on one slice of a batch, about ``SLICE`` bytes of text or one longer
document, so that the memory of a task follows neither the partition nor the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

# A word is a run of ASCII letters, digits and bytes over 127 (so of all other letters).
_FOLD = np.zeros(256, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``most`` bytes: (first, end, bytes, offsets)."""
    data, at = utf8(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _ODD_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def fold(data: np.ndarray) -> np.ndarray:
    """Lower-cased word bytes, 0 between words; ASCII and Latin-1 letters are folded."""
    sym = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        sym[1:][upper] += 0x20
    return sym


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, hashes of all words, and the first word of each document (with an end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    sym = fold(data)
    inside = sym != 0
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.concatenate(([True], ~inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | np.concatenate((~inside[1:], [True])))) + 1
    power, inverse = _grown(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(sym.astype(np.uint64) * power[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return starts, ends, hashes, np.searchsorted(starts, at)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` consecutive words, wherever documents end."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(length):
        out = out * _ODD + hashes[j:j + n]
    return mix(out)


def shingles(hashes: np.ndarray, first: np.ndarray, length: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of ``length`` words of a document.

    A document of fewer words has one shingle of all of them; one without words has none.
    """
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    whole = runs(hashes, length)
    keep = doc[:len(whole)] == doc[length - 1:length - 1 + len(whole)] if len(whole) else np.zeros(0, bool)
    docs, out = doc[:len(whole)][keep], whole[keep]
    short = np.flatnonzero((count > 0) & (count < length))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(length - 1):
            has = count[short] > j
            extra[has] = extra[has] * _ODD + hashes[first[short][has] + j]
        docs, out = np.concatenate((docs, short)), np.concatenate((out, mix(extra ^ count[short].astype(np.uint64))))
        order = np.argsort(docs, kind="stable")
        docs, out = docs[order], out[order]
    return docs, out

"""Word shingles of whole texts as sorted 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed in one numpy pass.
PIECE = 1 << 18
WORDS_PER_SHINGLE = 5

_U = np.uint64
_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)

_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64, in place."""
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.r_[_U(1), np.full(size - 1, _U(b))]) for b in (_BASE, inverse)]
    return _powers


def _hash_words(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of ``data``; a text begins at each place of ``first``."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    blank = _BLANK[data]
    edge = np.r_[True, blank[:-1]]
    edge[first[first < len(data)]] = True
    start = np.flatnonzero(edge & ~blank)
    edge = np.r_[blank[1:], True]
    edge[first[(first > 0) & (first <= len(data))] - 1] = True
    stop = np.flatnonzero(edge & ~blank) + 1
    up, down = _power_tables(len(data))
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=run[1:])
    return start, mixed((run[stop] - run[start]) * down[start] + (stop - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the number of words before it."""
    starts, hashes = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + PIECE, end)
        while stop < end:  # back to a blank or the start of a text, else on to the next blank
            texts = offsets[np.searchsorted(offsets, stop, "right") - 1]
            blanks = np.flatnonzero(_BLANK[data[max(at, int(texts)) : stop]])
            if texts > at or len(blanks):
                stop = max(int(texts), max(at, int(texts)) + (int(blanks[-1]) + 1 if len(blanks) else 0))
                break
            stop = min(stop + PIECE, end)
        inside = offsets[(offsets >= at) & (offsets < stop)] - at
        s, h = _hash_words(data[at:stop], inside)
        starts.append(s + at)
        hashes.append(h)
        at = stop
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(texts: pa.Array, n: int = WORDS_PER_SHINGLE) -> Iterator[np.ndarray]:
    """Per text its distinct shingles, as sorted hashes. Null or wordless texts have none.

    A text of fewer than ``n`` words has one, the whole sequence.
    """
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    hashes, before = word_hashes(data, offsets)
    total = len(hashes)
    full = max(0, total - n + 1)
    flat = hashes[:full] * _PLACE[0]
    for j in range(1, n):
        flat += hashes[j : full + j] * _PLACE[j]
    flat = mixed(flat)
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= n:
            own = flat[a : b - n + 1].copy()
            own.sort()
            yield own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own
        elif b > a:
            short = (hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACE[n + b - a]
            yield mixed(short)
        else:
            yield np.zeros(0, np.uint64)


def digests(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set that do not depend on its order, as signed integers."""
    if not len(own):
        return 0, 0
    other = mixed(own ^ _U(0xA5A5A5A5A5A5A5A5))
    return int(mixed(own.copy()).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(other * _PLACE[0]).view(np.int64))


def list_array(sets: list[np.ndarray]) -> pa.Array:
    """Unsigned hashes as an Arrow list of signed integers, without Python objects."""
    offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
    values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def array_sets(column: pa.Array) -> list[np.ndarray]:
    """The reverse of ``list_array``."""
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

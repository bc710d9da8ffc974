"""Shared text helpers: the word pattern and vectorised word hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of characters other than space and TAB, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 16
_SPACE_TABLE = bytes(int(b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256))


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _powers(base: int) -> np.ndarray:
    out = np.empty(_CHUNK, np.uint64)
    x = 1
    for i in range(_CHUNK):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


_POW: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (fixed public constants of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ordered(keys: np.ndarray, bits: int) -> np.ndarray:
    """Stable argsort of unsigned keys below 2**bits, by sorting keys and places packed together.

    numpy sorts plain 64-bit values several times faster than it argsorts. If
    key and place do not fit 64 bits, the key's low bits wait: only the few
    runs that they leave out of order are sorted again.
    """
    n = len(keys)
    width = max(1, n.bit_length())
    drop = np.uint64(max(0, bits + width - 64))
    packed = keys >> drop
    packed <<= np.uint64(width)
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << width) - 1)
    order = packed.view(np.int64)  # places are far below 2**63
    if drop:
        k = keys[order]
        wrong = np.flatnonzero(k[1:] < k[:-1])
        if len(wrong):
            again = np.flatnonzero(np.isin(k >> drop, np.unique(k[wrong] >> drop)))
            order[again] = order[again][np.argsort(k[again], kind="stable")]
    return order


def distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, number of each key among them), like ``np.unique`` with the inverse."""
    order = ordered(keys, bits)
    k = keys[order]
    new = np.append(True, k[1:] != k[:-1])[: len(k)]
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return k[new], inverse


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word in a byte string.

    The hash is a polynomial of the word's bytes modulo 2**64, read off prefix
    sums: words are never materialised one by one. Prefix sums restart every
    2**16 bytes so that powers come from one table; a longer word combines its
    pieces.
    """
    if not _POW:
        _POW["up"], _POW["down"] = _powers(_BASE), _powers(_BASE_INV)
    data = np.frombuffer(text, np.uint8)
    space = np.ones(len(data) + 2, np.uint8)
    space[1:-1] = np.frombuffer(text.translate(_SPACE_TABLE), np.uint8)
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[0::2], edge[1::2]
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    for a in range(0, n, _CHUNK):
        b = min(n, a + _CHUNK)
        part = data[a:b].astype(np.uint64)
        part += np.uint64(1)
        part *= _POW["up"][: b - a]
        np.cumsum(part, out=prefix[a + 1 : b + 1])
    # prefix[i] sums the bytes of i's chunk before i; at a chunk's first byte it holds the chunk before.
    head = start & (_CHUNK - 1)
    before = prefix[start]
    before[head == 0] = 0
    same = (end - 1) >> 16 == start >> 16
    hashes = (prefix[end] - before) * _POW["down"][head]
    for i in np.flatnonzero(~same):
        s, e = int(start[i]), int(end[i])
        h, scale = 0, 1
        while s < e:
            stop = min(e, (s // _CHUNK + 1) * _CHUNK)
            piece = int(prefix[stop]) - (int(prefix[s]) if s % _CHUNK else 0)
            piece = piece * int(_POW["down"][s % _CHUNK]) & 0xFFFFFFFFFFFFFFFF
            h = (h + piece * scale) & 0xFFFFFFFFFFFFFFFF
            scale = scale * pow(_BASE, stop - s, 1 << 64) & 0xFFFFFFFFFFFFFFFF
            s = stop
        hashes[i] = h
    return mix(hashes ^ (end - start).astype(np.uint64)), start, end

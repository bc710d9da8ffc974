"""Elias-Fano sequences and an n-gram trie on them, queried in whole arrays.

A level of the trie keeps, for its nodes in trie order, the word ids (ascending
among siblings; each family is shifted by the last value before it, so the
level is one monotone sequence), pointers to the children (monotone) and 8-bit
codes of smoothed probabilities. All parts are views of one flat buffer, which
may as well be a memory map.
"""

import mmap

import numpy as np

U = np.uint64
#: Codes 1..255 stand for log10 probabilities from LOWEST to 0, code 0 for zero.
LOWEST = -12.0


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.rint(255 - np.log10(np.maximum(p, 1e-300)) * 254 / LOWEST)
    return np.where(p > 0, np.clip(code, 1, 255), 0).astype(np.uint8)


_VALUES = np.concatenate([[0.0], 10 ** ((255 - np.arange(1, 256)) * LOWEST / 254)])


def dequantise(code: np.ndarray) -> np.ndarray:
    return _VALUES[code]


def _select(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each 64-bit word."""
    at = np.zeros(len(words), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = words & U((1 << width) - 1)
        c = np.bitwise_count(low).astype(np.int64)
        up = r >= c
        r = r - c * up
        at += width * up
        words = np.where(up, words >> U(width), low)
    return at


class EliasFano:
    """A monotone sequence of unsigned 64-bit integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.l, self.high = n, low_bits, high
        # 8-byte windows at every byte, for reading bit fields that cross words
        self.low = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,))
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.zeros = 64 * np.arange(len(high) + 1) - self.ones

    @staticmethod
    def parts(values: np.ndarray) -> list[np.ndarray]:
        """Header, low bits and high bits of a sequence, each a multiple of 8 bytes."""
        n = len(values)
        top = int(values[-1]) if n else 0
        l = min(56, max(0, (top // max(1, n)).bit_length() - 1)) if n else 0  # noqa: E741
        low = np.zeros((n * l + 7) // 8 // 8 * 8 + 16, np.uint8)
        for a in range(0, n, 1 << 16) if l else ():  # 2**16 fields start on a byte border
            part = (values[a : a + (1 << 16)] & U((1 << l) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(part, axis=1, count=l, bitorder="little")
            packed = np.packbits(bits.ravel(), bitorder="little")
            low[a * l // 8 : a * l // 8 + len(packed)] = packed
        high = (values >> U(l)).astype(np.int64)
        bits = np.zeros(((n + (int(high[-1]) if n else 0) + 2) + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little")
        return [np.array([n, l, len(low), len(words)], np.int64).view(np.uint8), low, words]

    @classmethod
    def read(cls, buffer: np.ndarray, at: int) -> tuple["EliasFano", int]:
        n, l, lows, highs = buffer[at : at + 32].view(np.int64).tolist()  # noqa: E741
        at += 32
        return cls(n, l, buffer[at : at + lows], buffer[at + lows : at + lows + highs].view(np.uint64)), at + lows + highs

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i * self.l
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & U((1 << self.l) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        at = word * 64 + _select(self.high[word], i - self.ones[word])
        return ((at - i).astype(np.uint64) << U(self.l)) | self._lows(i)

    def _below(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits under h."""
        k = np.maximum(h - 1, 0)
        out = np.full(len(h), self.n, np.int64)
        inside = k < self.zeros[-1]
        word = np.searchsorted(self.zeros, k[inside], "right") - 1
        out[inside] = word * 64 + _select(~self.high[word], k[inside] - self.zeros[word]) - k[inside]
        return np.where(h <= 0, 0, out)

    def successor(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place in [start, stop) whose value is at least x, whether it is x); stop if none is."""
        h, want = (x >> U(self.l)).astype(np.int64), x & U((1 << self.l) - 1)
        lo = np.clip(self._below(h), start, stop)
        end = np.clip(self._below(h + 1), start, stop)
        hi = end.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        found = lo < end
        found[found] = self._lows(lo[found]) == want[found]
        return lo, found


class Trie:
    """Levels of (ids, child pointers, codes, weights); level 0 also has exact counts."""

    @staticmethod
    def build(ids: list[np.ndarray], children: list[np.ndarray], counts: np.ndarray, codes: list[np.ndarray],
              weights: list[np.ndarray]) -> mmap.mmap:
        """Lay the levels down in one memory map. ids: per level in trie order; children: per inner level."""
        parts = [np.array([len(ids)], np.int64).view(np.uint8)]
        for k, own in enumerate(ids):
            if k:
                family = children[k - 1]
                last = np.cumsum(family) - 1
                full = family > 0
                # Each family is shifted by the sum of the last ids of the families before it.
                ends = np.where(full, own[np.maximum(last, 0)], U(0)).astype(np.uint64)
                own = own.astype(np.uint64) + np.repeat(np.cumsum(ends) - ends, family)
            parts += EliasFano.parts(own.astype(np.uint64))
            pointers = np.concatenate([[0], np.cumsum(children[k])]) if k < len(children) else np.zeros(1)
            parts += EliasFano.parts(pointers.astype(np.uint64))
            for flat in (counts.astype(np.int64) if k == 0 else np.zeros(0, np.int64), codes[k], weights[k]):
                raw = flat.view(np.uint8)
                parts += [np.array([len(raw)], np.int64).view(np.uint8), raw, np.zeros(-len(raw) % 8, np.uint8)]
        buffer = mmap.mmap(-1, max(8, sum(map(len, parts))))
        for p in parts:
            buffer.write(p.tobytes())
        return buffer

    def __init__(self, buffer):
        flat = np.frombuffer(buffer, np.uint8)
        self.levels, at = [], 8
        for _ in range(int(flat[:8].view(np.int64)[0])):
            ids, at = EliasFano.read(flat, at)
            pointers, at = EliasFano.read(flat, at)
            arrays = []
            for kind in (np.int64, np.uint8, np.uint8):
                size = int(flat[at : at + 8].view(np.int64)[0])
                arrays.append(flat[at + 8 : at + 8 + size].view(kind))
                at += 8 + size + -size % 8
            self.levels.append((ids, pointers, *arrays))

    def find(self, level: int, parents: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
        """Node of each id among its parent's children, -1 if there is none (or no parent)."""
        seq = self.levels[level][0]
        out = np.full(len(ids), -1, np.int64)
        if parents is None:
            at, found = seq.successor(ids.astype(np.uint64), np.zeros(len(ids), np.int64), np.full(len(ids), seq.n, np.int64))
            out[found] = at[found]
            return out
        known = np.flatnonzero(parents >= 0)
        up = self.levels[level - 1][1]
        start, stop = up[parents[known]].astype(np.int64), up[parents[known] + 1].astype(np.int64)
        known, start, stop = known[start < stop], start[start < stop], stop[start < stop]
        base = np.where(start > 0, seq[np.maximum(start - 1, 0)] if seq.n else U(0), U(0))
        at, found = seq.successor(base + ids[known].astype(np.uint64), start, stop)
        out[known[found]] = at[found]
        return out

"""A compressed full-text index over word sequences, searched for many patterns at once."""

import numpy as np

U = np.uint64


class BitVector:
    """Bits with constant-time rank: 64-bit words and a count before each."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = self.words[w] & ((U(1) << (i & 63).astype(np.uint64)) - U(1))
        return self.before[w].astype(np.int64) + np.bitwise_count(low)


class WaveletTree:
    """Wavelet tree with its levels laid side by side: at each, symbols with a 0 bit go first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[int, BitVector, int]] = []
        for b in range(self.depth - 1, -1, -1):
            bit = (symbols >> b) & 1
            zeros = bit == 0
            self.levels.append((b, BitVector(bit.astype(np.uint8)), int(zeros.sum())))
            symbols = np.concatenate([symbols[zeros], symbols[~zeros]])
        self.start = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, bits, zeros in self.levels:
            ones = bits.rank1(i)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before place i."""
        return self._walk(symbol, i) - self.start[symbol]


class FMIndex:
    """Index of ``text`` (symbols 0..sigma-1) for patterns of at most ``longest`` symbols."""

    def __init__(self, text: np.ndarray, sigma: int, longest: int):
        n, rank, h = len(text), text.astype(np.int64), 1
        # Prefix doubling; suffixes that agree on more than ``longest`` symbols may stand in any order.
        while h < longest:
            ahead = np.full(n, -1, np.int64)
            ahead[: max(0, n - h)] = rank[h:]
            key = rank * (n + sigma + 1) + ahead + 1
            values, rank = np.unique(key, return_inverse=True)
            if len(values) == n:
                break
            h *= 2
        self.places = np.argsort(rank, kind="stable")
        self.wavelet = WaveletTree(text[self.places - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.n = n

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of symbol + pattern from the interval of the pattern."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.smaller[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]


def repeated_windows(segments: list[np.ndarray], window: int, block: int = 1 << 17):
    """Windows of ``window`` words that occur at least twice in ``segments``.

    Returns (segment, offset, lowest) of each such window, where ``lowest(keys)``
    gives, for an integer key per text place, each window's smallest key over
    all its occurrences; and the text place of every segment's first word.
    Matching statistics are taken only as far as they matter: a window is
    followed backwards while more than its own occurrence matches.
    """
    sizes = np.array([len(s) for s in segments], np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    words, ids = np.unique(np.concatenate(segments), return_inverse=True)
    text = np.zeros(int(sizes.sum()) + len(segments) + 1, np.int64)  # 0 stands between segments
    text[np.repeat(begins, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = ids + 1
    index = FMIndex(text, len(words) + 1, window)
    count = np.maximum(sizes - window + 1, 0)
    segment = np.repeat(np.arange(len(segments)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = begins[segment] + offset
    left, lows, highs = [], [], []
    for a in range(0, len(at), block):
        q = np.arange(a, min(a + block, len(at)))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), index.n, np.int64)
        for k in range(window - 1, -1, -1):
            lo, hi = index.extend(text[at[q] + k], lo, hi)
            more = hi - lo > 1
            q, lo, hi = q[more], lo[more], hi[more]
        left.append(q)
        lows.append(lo)
        highs.append(hi)
    q, lo, hi = np.concatenate(left), np.concatenate(lows), np.concatenate(highs)
    # Intervals of equally long patterns are equal or disjoint, so one pass over them is enough.
    starts, which = np.unique(lo, return_inverse=True)
    ends = np.zeros(len(starts), np.int64)
    ends[which] = hi

    def lowest(keys: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, keys.dtype)
        inside = np.append(keys[index.places], keys[:1])
        cuts = np.stack([starts, ends], 1).ravel()
        return np.minimum.reduceat(inside, cuts)[::2][which]

    return segment[q], offset[q], lowest, begins



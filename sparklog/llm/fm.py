"""A compressed full-text index over integer symbols: BWT in a wavelet matrix, backward search.

Suffixes are sorted by their first ``span`` symbols, which is all that patterns of up to
``span`` symbols need, and equal ones by place. What is kept: the wavelet matrix of the
BWT (1.5 to 2 bits a symbol and level), two bit vectors that mark where runs of suffixes with equal
first ``span`` and ``span - 1`` symbols begin, and one sampled place a run, of its first
suffix. Every query is an array operation over many patterns at once.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class Bits:
    """A bit vector in 64-bit words with a count per word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) // 64 * 64 + 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)
        self.ones = int(counts.sum())

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.before.nbytes

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        w, r = i >> 6, (i & 63).astype(U64)
        low = self.words[w] & ((U64(1) << r) - U64(1))
        return self.before[w] + np.bitwise_count(low).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of one number k (from 0)."""
        w = np.searchsorted(self.before, k, side="right") - 1
        left, word, at = k - self.before[w], self.words[w], np.zeros(len(k), U64)
        for step in (32, 16, 8, 4, 2, 1):
            ones = np.bitwise_count((word >> at) & U64((1 << step) - 1)).astype(np.int64)
            right = left >= ones
            left = np.where(right, left - ones, left)
            at = np.where(right, at + U64(step), at)
        return (w << 6) + at.astype(np.int64)


class FMIndex:
    """Index of ``text`` (symbols from 0; 0 stands between texts and in no pattern) for patterns of up to ``span`` symbols."""

    def __init__(self, text: np.ndarray, span: int):
        rank, depth = text.astype(np.int64), 1
        steps = [(1, rank)]  # ranks by first `depth` symbols
        while 2 * depth <= span:
            rank = self._pair(rank, rank, depth)
            depth *= 2
            steps.append((depth, rank))
        self.n, self.span = len(text), span
        whole, parent = self._upto(steps, span), self._upto(steps, span - 1)
        order = np.argsort(whole, kind="stable")
        heads = np.append(True, np.diff(whole[order]) != 0)[: self.n]
        self.runs, self.parents = Bits(heads), Bits(np.append(True, np.diff(parent[order]) != 0)[: self.n])
        self.sample = order[heads].astype(np.int32)
        bwt = text[order - 1]  # before the first symbol stands the last
        self.sigma = int(text.max(initial=0)) + 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=self.sigma))])
        self.levels: list[tuple[int, int, Bits]] = []
        for level in reversed(range(max(1, int(self.sigma - 1).bit_length()))):
            bit = (bwt >> level) & 1
            held = Bits(bit)
            self.levels.append((level, self.n - held.ones, held))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        symbols = np.arange(self.sigma)
        self.begin = self._walk(symbols, np.zeros(self.sigma, np.int64)).astype(np.int32)

    @property
    def nbytes(self) -> int:
        """Bytes kept for the text, without the tables by symbol."""
        return self.runs.nbytes + self.parents.nbytes + self.sample.nbytes + sum(b.nbytes for _, _, b in self.levels)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        far = np.zeros(len(b), np.int64)
        far[: max(len(b) - shift, 0)] = b[shift:] + 1
        return np.unique(a * (int(b.max(initial=0)) + 2) + far, return_inverse=True)[1].reshape(-1)

    @classmethod
    def _upto(cls, steps: list[tuple[int, np.ndarray]], size: int) -> np.ndarray:
        """Ranks by the first ``size`` symbols from those by powers of two."""
        got, out = 0, np.zeros(len(steps[0][1]), np.int64)
        for depth, rank in reversed(steps):
            if got + depth <= size:
                out = cls._pair(out, rank, got) if got else rank
                got += depth
        return out

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, zeros, bits in self.levels:
            one = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + one, i - one)
        return i

    def extend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The bound that bound i becomes when patterns of fewer than ``span`` symbols are extended to the left by these symbols."""
        return self.below[symbol] + self._walk(symbol, i) - self.begin[symbol]

    def widen(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all suffixes that share their first ``span - 1`` symbols with suffix ``lo``."""
        run = self.parents.rank(lo + 1) - 1
        last = run + 1 >= self.parents.ones
        return self.parents.select(run), np.where(last, self.n, self.parents.select(np.where(last, run, run + 1)))

    def earliest(self, lo: np.ndarray) -> np.ndarray:
        """The first place in the text of the ``span`` symbols whose interval begins at ``lo``."""
        return self.sample[self.runs.rank(lo + 1) - 1].astype(np.int64)

    def stream(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics, cut off at ``span``, of the texts that end before ``ends`` in ``text`` and begin
        behind a 0 or at its start, by backward search over all of them at once: the interval of each place
        whose next ``span`` symbols occur in the index (elsewhere an empty one, 0 to 0)."""
        out_lo, out_hi = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        end = np.array(ends, np.int64)
        place, depth = end - 1, np.zeros(len(end), np.int64)
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.n, np.int64)
        on = lambda x: x[(place[x] >= 0) & (text[np.maximum(place[x], 0)] > 0)]
        alive = on(np.arange(len(end))) if len(text) else np.zeros(0, np.int64)
        while len(alive):
            full = alive[depth[alive] == self.span]
            lo[full], hi[full] = self.widen(lo[full])  # drops the last symbol
            depth[full] -= 1
            end[full] -= 1
            c = text[place[alive]]
            known = np.minimum(c, self.sigma - 1)
            a, b = self.extend(known, lo[alive]), self.extend(known, hi[alive])
            met = (c < self.sigma) & (a < b)
            yes, no = alive[met], alive[~met]
            lo[yes], hi[yes] = a[met], b[met]
            depth[yes] += 1
            hit = yes[depth[yes] == self.span]
            out_lo[place[hit]], out_hi[place[hit]] = lo[hit], hi[hit]
            place[yes] -= 1
            # No match: on without the last symbol of what matched, or without this one if nothing did.
            end[no] = np.where(depth[no] > 0, end[no] - 1, place[no])
            place[no], depth[no], lo[no], hi[no] = end[no] - 1, 0, 0, self.n
            alive = on(alive)
        return out_lo, out_hi

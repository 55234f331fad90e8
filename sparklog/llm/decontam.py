"""Benchmark decontamination by the q-gram lemma.

Texts are compared as lower-case letters and digits with single spaces (case and punctuation
by code point up to U+07FF, and the general and CJK punctuation blocks). An item of n such
bytes may occur with k = EDIT_RATE * n edits. An occurrence then keeps at least
``n - q + 1 - k * q`` of the item's q-grams, on diagonals (place in the text minus place
in the item) within k of each other. Shared q-grams are counted in diagonal bands of
width 2(k+1) that overlap by half, so some band holds them all; a band that reaches the
bound is aligned with the item in a band of diagonals, and kept within k edits. Pairs of a
text and an item that share fewer q-grams in all go first, counted by distinct q-gram; pairs
that repeat their q-grams so often that bands would cost more than the whole are aligned
over the whole text, so repetitive texts cost neither memory nor matches.

Items of fewer than q bytes are too short to tell from chance and match nothing. Items
too short for the bound at k edits get the most edits that it allows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm import runtime
from sparklog.llm.kernels import LOWER, U64, mix, parts, ragged

Q = 10
EDIT_RATE = 0.08
TABLE_BITS = 22
#: Benchmark bytes held in one index; a larger benchmark is matched in blocks of this size.
BLOCK_BYTES = 4 << 20

#: Pairs counted at once, and hits of a pair, per byte of its text and item, beyond which bands are not counted.
COUNTED, DENSE = 1 << 22, 4

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_LOW = [chr(c).lower() for c in range(0x800)]
#: Of code points in two bytes: the lower-case one, and whether it is a letter, digit or mark.
_FOLD = np.array([ord(x) if len(x) == 1 and 0x80 <= ord(x) < 0x800 else c for c, x in enumerate(_LOW)], np.int64)
_LETTER = np.array([chr(c).isalnum() or unicodedata.category(chr(c)).startswith("M") for c in range(0x800)])


def _letters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes, and which belong to letters and digits."""
    low, word = LOWER[buf], _WORD[buf]
    if not len(buf) or buf.max() < 0x80:
        return low, word
    at = np.flatnonzero((buf[:-1] >= 0xC2) & (buf[:-1] < 0xE0))
    point = (buf[at].astype(np.int64) & 0x1F) << 6 | (buf[at + 1] & 0x3F)
    low[at], low[at + 1] = 0xC0 | _FOLD[point] >> 6, 0x80 | _FOLD[point] & 0x3F
    sign = at[~_LETTER[point]]
    word[sign] = word[sign + 1] = False
    at = np.flatnonzero(((buf[:-2] == 0xE2) & ((buf[1:-1] | 1) == 0x81)) | ((buf[:-2] == 0xE3) & (buf[1:-1] == 0x80)))  # U+2000-207F, U+3000-303F
    word[at] = word[at + 1] = word[at + 2] = False
    return low, word


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of rows, their offsets, and the place of each byte in ``buf``."""
    low, word = _letters(buf)
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep &= word | ~first[:-1]
    at = np.flatnonzero(keep)
    return np.where(word, low, 32)[at].astype(np.uint8), np.searchsorted(at, off), at


def gram_codes(text: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit code of each run of ``q`` bytes (8 to 16)."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    eight = np.empty(len(text) - 7, U64)
    for j in range(8):
        k = (len(text) - j) // 8
        if k:
            eight[j::8] = np.frombuffer(text[j : j + 8 * k].tobytes(), "<u8")
    return mix(eight[:n] ^ mix(eight[q - 8 : q - 8 + n]))


def short_codes(text: np.ndarray, q: int = Q) -> np.ndarray:
    """32 bits of each code. Runs that share them by chance only add to counts, which are lower bounds to pass."""
    return (gram_codes(text, q) >> U64(32)).astype(np.uint32)


class Index:
    """Q-grams of a block of benchmark items (about 14 bytes for each of the block's): a table for a first test, and sorted codes with their items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, edit_rate: float = EDIT_RATE):
        self.q = q
        self.ids, self.text = [], []
        codes, owner = [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            norm, _, _ = normal(raw, np.array([0, len(raw)]))
            norm = norm[:-1] if len(norm) and norm[-1] == 32 else norm
            if len(norm) < q:
                continue
            c = short_codes(norm, q)
            codes.append(c)
            owner.append(np.full(len(c), len(self.ids), np.int32))
            self.ids.append(item_id)
            self.text.append(norm)
        n = np.array([len(t) for t in self.text], np.int64)
        self.size = n
        self.budget = np.minimum((edit_rate * n).astype(np.int64), (n - q) // q)
        self.least = n - q + 1 - self.budget * q
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int32)
        # Items by distinct code, and how often each has it.
        order = np.argsort(code.astype(U64) << U64(32) | owner.astype(U64))
        code, owner = code[order], owner[order]
        head = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)])
        self.item, self.times = owner[head], np.diff(np.append(head, len(code))).astype(np.int32)
        self.codes, first = np.unique(code[head], return_index=True)
        self.first = np.append(first, len(head)).astype(np.int32)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.codes >> np.uint32(32 - TABLE_BITS)] = True

    def _pairs(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and items that share as many q-grams as a match needs, and how many they share."""
        key, times = np.unique(row * len(self.codes) + code, return_counts=True)
        row, code = np.divmod(key, len(self.codes))
        n = (self.first[code + 1] - self.first[code]).astype(np.int64)
        ends = np.cumsum(n)
        keys, hits, at = [], [], 0
        while at < len(key):  # in steps of bounded size
            end = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + COUNTED, side="right")))
            post = ragged(self.first[code[at:end]], n[at:end])
            pair, back = np.unique(np.repeat(row[at:end], n[at:end]) * len(self.ids) + self.item[post].astype(np.int64), return_inverse=True)
            keys.append(pair)
            hits.append(np.bincount(back.reshape(-1), np.repeat(times[at:end], n[at:end]) * self.times[post]))
            at = end
        pair, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back.reshape(-1), np.concatenate(hits))
        row, item = np.divmod(pair, len(self.ids))
        good = total >= self.least[item]
        return row[good], item[good], total[good]

    def matches(self, off: np.ndarray, buf: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first byte, end byte) of each row and item that match, best alignment."""
        text, rows, at = normal(buf, off)
        codes = short_codes(text, self.q)
        if not len(codes) or not len(self.codes):
            return []
        pos = np.flatnonzero(self.table[codes >> np.uint32(32 - TABLE_BITS)])
        code = np.minimum(np.searchsorted(self.codes, codes[pos]), len(self.codes) - 1)
        row = np.searchsorted(rows, pos, side="right") - 1
        fits = (self.codes[code] == codes[pos]) & (pos + self.q <= rows[row + 1])
        pos, code, row = pos[fits], code[fits], row[fits]
        if not len(pos):
            return []
        out = []
        for r, i, hits in zip(*(x.tolist() for x in self._pairs(row, code))):
            begin, end = int(rows[r]), int(rows[r + 1])
            own = text[begin:end]
            got = None
            if (exact := own.tobytes().find(self.text[i].tobytes())) >= 0:
                got = 0, exact, exact + len(self.text[i])
            else:
                a, b = np.searchsorted(row, r), np.searchsorted(row, r, side="right")
                bands = self._bands(i, pos[a:b] - begin, code[a:b]) if hits <= DENSE * (len(own) + len(self.text[i])) else None
                k = int(self.budget[i])
                if bands is None or len(bands) * 4 * (k + 1) > len(own):
                    got = self._whole(i, own)
                else:
                    for band in bands.tolist():
                        base = band * (k + 1) - k
                        start = max(0, base)
                        stop = min(len(own), band * (k + 1) + 2 * (k + 1) + int(self.size[i]) + k)
                        new = self._verify(i, own[start:stop], base - start, 2 * (k + 1) + 2 * k)
                        if new and (got is None or new[0] < got[0]):
                            got = new[0], start + new[1], start + new[2]
            if got:
                out.append((r, i, got[0], int(at[begin + got[1]]), int(at[begin + got[2] - 1]) + 1))
        return out

    def _bands(self, i: int, pos: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Diagonal bands of a text and an item that reach the bound. Each hit counts in the two bands that overlap on its diagonal."""
        own = np.searchsorted(self.codes, short_codes(self.text[i], self.q))
        place = np.argsort(own, kind="stable")
        own = own[place]
        lo, hi = np.searchsorted(own, code), np.searchsorted(own, code, side="right")
        band = (np.repeat(pos, hi - lo) - place[ragged(lo, hi - lo)]) // (self.budget[i] + 1)
        found, count = np.unique(np.concatenate([band, band - 1]), return_counts=True)
        return found[count >= self.least[i]]

    def _whole(self, i: int, text: np.ndarray) -> tuple[int, int, int] | None:
        """Edits, first byte and end byte of the item's best place in the text, over all diagonals, or None beyond the budget."""
        item, k = self.text[i], int(self.budget[i])
        step = np.arange(len(text) + 1, dtype=np.int32)
        cost = np.zeros(len(text) + 1, np.int32)
        for c in item.tolist():
            new = cost + 1  # the item's byte is missing in the text
            np.minimum(new[1:], cost[:-1] + (text != c), out=new[1:])
            new -= step
            cost = np.minimum.accumulate(new) + step  # extra bytes in the text
        end = int(cost.argmin())
        if cost[end] > k:
            return None
        edits = int(cost[end])
        start = max(0, end - len(item) - k)
        _, size = banded(item[::-1], text[start:end][::-1], -k, 2 * k + 1, anchored=True)
        return edits, end - size, end

    def _verify(self, i: int, region: np.ndarray, shift: int, width: int) -> tuple[int, int, int] | None:
        """Edits, first byte and end byte of the item in the region, or None beyond the budget."""
        item, k = self.text[i], int(self.budget[i])
        edits, end = banded(item, region, shift, width)
        if edits > k:
            return None
        _, size = banded(item[::-1], region[:end][::-1], -k, 2 * k + 1, anchored=True)
        return edits, end - size, end


def banded(item: np.ndarray, region: np.ndarray, shift: int, width: int, anchored: bool = False) -> tuple[int, int]:
    """Least edits of the whole item against a stretch of the region on diagonals shift .. shift+width,
    and where that stretch ends (the shortest of equals). It begins anywhere, or at 0 if ``anchored``."""
    far = 1 << 20
    d = np.arange(width + 1)
    place = d + shift  # of the cell in the region, for 0 bytes of the item
    cost = np.where((place < 0) | (place > len(region)), far, np.abs(place) if anchored else 0)
    for i, c in enumerate(item.tolist()):
        at = place + i  # the region's byte that a diagonal step takes
        inside = (at >= 0) & (at < len(region))
        same = np.zeros(len(d), bool)
        same[inside] = region[at[inside]] == c
        step = np.where(inside, cost + ~same, far)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)  # the item's byte is missing in the region
        step[(at + 1 < 0) | (at + 1 > len(region))] = far
        cost = np.minimum(np.minimum.accumulate(step - d) + d, far)  # extra bytes in the region
        cost[(at + 1 < 0) | (at + 1 > len(region))] = far
    best = int(cost.argmin())
    return int(cost[best]), int(place[best] + len(item))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded bytes, fetched partition by partition."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _indexes(spark, benchmark: DataFrame, id_col: str, text_col: str) -> list:
    return [spark.sparkContext.broadcast(Index(block)) for block in _blocks(benchmark, id_col, text_col)]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per matching pair: ``doc_id, item_id, edits, start, end`` (code points of the best alignment).

    Null texts and items of fewer than Q normalised bytes match nothing, repeated rows give repeated pairs, an empty
    table on either side gives none, and other columns are ignored. Documents are read once, whatever the benchmark's size.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    held = _indexes(spark, benchmark, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, off, buf, _ in parts(batch.column(1), 1 << 19):
                rows = []
                for index in (h.value for h in held):
                    for r, i, edits, b, e in index.matches(off, buf):
                        points = np.cumsum((buf[off[r] : e] & 0xC0) != 0x80)
                        rows.append((doc_ids[lo + r], index.ids[i], edits, int(points[b - off[r]]) - 1, int(points[-1])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return runtime.texts(docs).mapInArrow(runtime.lean(run), "doc_id long, item_id long, edits long, start long, end long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows in which some item occurs; clean rows stay as they are."""
    spark = docs.sparkSession
    runtime.tune(spark)
    at = docs.columns.index("text")
    held = _indexes(spark, benchmark, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, off, buf, _ in parts(batch.column(at), 1 << 19):
                for h in held:
                    keep[[lo + m[0] for m in h.value.matches(off, buf)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(runtime.lean(run), docs.schema)

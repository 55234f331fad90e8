"""Array kernels over the UTF-8 bytes of an Arrow string column.

A batch of texts is one byte buffer with offsets; words, hashes and shingles are
found for all its texts at once, without a Python object for each word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Multiplier of the polynomial hash and finaliser multipliers: any odd 64-bit numbers do.
BASE = U64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = U64(pow(int(BASE), -1, 1 << 64))
        steps = np.full(size, BASE, U64)
        steps[0] = 1
        back = np.full(size, inverse, U64)
        back[0] = 1
        _powers[:] = [np.multiply.accumulate(steps), np.multiply.accumulate(back)]
    return _powers[0], _powers[1]


def parts(column, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, pa.Array]]:
    """Runs of rows of at most ``max_bytes`` of text (one row at least): first row, end row,
    offsets (from 0), bytes and the rows themselves. Nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(off, off[at] + max_bytes, side="right")) - 1)
        end = min(end, len(column))
        yield at, end, off[at : end + 1] - off[at], raw[off[at] : off[end]], column.slice(at, end - at)
        at = end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs outside white space [\\x20\\x09-\\x0D], never across rows: start bytes,
    end bytes, and per row the index of its first word (one entry more than rows)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~SPACES[buf]
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    before[off[:-1][off[:-1] < len(buf)]] = False
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends_at = off[1:] - 1
    after[ends_at[ends_at >= 0]] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    power, back = _power_tables(len(buf) + 1)
    sums = np.empty(len(buf) + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U64) * MIX_B)


def gram_hashes(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (runs across rows included; callers mask them)."""
    if len(word_hash) < n:
        return np.zeros(0, U64)
    size = len(word_hash) - n + 1
    total = np.zeros(size, U64)
    for i in range(n):
        total = total * BASE + word_hash[i : i + size]
    return mix(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (lengths[i] of them) for every i, in order."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - firsts, lengths)

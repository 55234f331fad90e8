"""Cost-balanced packing of documents into sequences for training.

A piece of n tokens costs about ``n + n * n / length`` (a linear part, and attention
inside the document). Documents are cut into full sequences and a tail; of a group of
documents, tails go in descending order each to the lowest-cost sequence that still
has room. Tails that fit nowhere are cut to fill the gaps, so every sequence of a group
is full but for the last few, whose sizes are the powers of two of the remainder.

Groups are made of the documents of one scan partition (about ``GROUP`` tokens each), so
nothing is shuffled and memory does not grow with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparklog.llm import runtime
from sparklog.llm.idfiles import encoder
from sparklog.llm.kernels import parts

GROUP = 1 << 20


def plan(lengths: np.ndarray, length: int = 2048) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, size, sequence, offset) of documents of these lengths; every
    token lies in one piece, sequences are gapless and of at most ``length`` tokens."""
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    tails: list[tuple[int, int, int]] = []  # size, document, start
    for d, n in enumerate(lengths.tolist()):
        full = n // length
        for i in range(full):
            out.append((d, i * length, length, seq, 0))
            seq += 1
        if n % length:
            tails.append((n % length, d, full * length))
    total = sum(t[0] for t in tails)
    bins = total // length
    cost, used = np.zeros(bins), np.zeros(bins, np.int64)
    rest = []
    for n, d, start in sorted(tails, key=lambda t: (-t[0], t[1])):
        open_cost = np.where(used + n <= length, cost, np.inf)
        k = int(open_cost.argmin()) if bins else 0
        if not bins or open_cost[k] == np.inf:
            rest.append([n, d, start])
            continue
        out.append((d, start, n, seq + k, int(used[k])))
        used[k] += n
        cost[k] += n + n * n / length
    gaps = [(seq + int(k), int(used[k]), length - int(used[k])) for k in np.lexsort((np.arange(bins), cost)) if used[k] < length]
    left = total - bins * length
    last = seq + bins
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            gaps.append((last, 0, 1 << bit))
            last += 1
    at = 0
    for n, d, start in rest:
        while n:
            k, offset, room = gaps[at]
            m = min(n, room)
            out.append((d, start, m, k, offset))
            n, start = n - m, start + m
            gaps[at] = (k, offset + m, room - m)
            at += room == m
    return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = 2048) -> DataFrame:
    """Pieces of all ``docs`` (null text: empty, so only the end id): ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``. Repeated rows are packed each; an empty table gives no rows."""
    runtime.tune(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        first = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal first
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            begin = np.cumsum(counts) - counts
            pieces = np.array(plan(counts, length), np.int64)
            d, start, size, seq, offset = pieces.T
            raw = ids.astype("<u4")
            at = (begin[d] + start).tolist()
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(at, size.tolist())]
            got = [doc_ids[d], start, size, np.array(crc, np.int64), counts[d], seq + first, offset]
            first += int(seq.max()) + 1
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in got], schema=schema)

        gathered = 0
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, off, buf, rows in parts(batch.column(1)):
                ids, counts = tool.encode(rows, off, buf)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                held.append((doc_ids[lo:hi], counts + 1, ids))
                gathered += len(ids)
                if gathered >= GROUP:
                    yield close()
                    gathered = 0
        if held:
            yield close()

    return runtime.texts(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))

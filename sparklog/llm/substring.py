"""Removal of passages that occur earlier in the corpus, by FM-indexes over shards.

A window is SPAN consecutive words of a document. Of the GRAM-word grams of a window the
one of least hash is its anchor, so equal windows have equal anchors. The windows of a
document that share an anchor form a segment (SPAN to SPAN + 12 words). Anchors that
occur once cannot hold a repeated window. Of the others, each distinct segment goes once,
with its earliest place, to the shard of its anchor; the shard builds an FM-index over
its segments and streams them through it by backward search. Each window's interval in the
index tells whether it repeats and where first. Copies of a segment get its answer by
a join. Words under a window that starts earlier elsewhere are removed.

An anchor with more distinct segments than HOT (a passage that very many documents set in
words of their own) is split by window: its windows' earliest places come from a minimum by
window hash, which is combined before it is shuffled, so no anchor is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm import runtime
from sparklog.llm.fm import FMIndex
from sparklog.llm.kernels import BASE, U64, gram_hashes, mix, parts, ragged, span_hashes, words

SPAN, GRAM = 20, 8
#: Words in one index, unless one anchor has more: a task's anchors are indexed in shards of this size, one at a time.
SHARD_WORDS = 1 << 18
#: Distinct segments of one anchor that go into one index.
HOT = 1 << 15


def segments(first: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of words with hashes ``h``: each segment's row, first word in the row, windows, and anchor hash."""
    per_row = np.diff(first)
    windows = np.maximum(per_row - SPAN + 1, 0)
    none = np.zeros(0, np.int64)
    if not windows.sum():
        return none, none, none, np.zeros(0, U64)
    g = gram_hashes(h, GRAM)
    width = SPAN - GRAM + 1
    best, at, size = g, np.arange(len(g)), 1

    def joined(best, at, shift, n):
        left = best[:n] <= best[shift : shift + n]
        return np.where(left, best[:n], best[shift : shift + n]), np.where(left, at[:n], at[shift : shift + n])

    while 2 * size <= width:
        best, at = joined(best, at, size, len(best) - size)
        size *= 2
    if size < width:
        best, at = joined(best, at, width - size, len(best) - (width - size))
    start = ragged(first[:-1], windows)
    row = np.repeat(np.arange(len(per_row)), windows)
    anchor = at[start]
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])))
    count = np.diff(np.append(head, len(start)))
    return row[head], start[head] - first[row[head]], count, g[anchor[head]]


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each run start..end of word hashes."""
    total = np.zeros(len(start), U64)
    longest = int((end - start).max(initial=0))
    for i in range(longest):
        inside = start + i < end
        total = np.where(inside, total * BASE + h[np.minimum(start + i, len(h) - 1)], total)
    return mix(total + (end - start).astype(U64))


def earliest(doc: np.ndarray, begin: np.ndarray, n_words: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard's segments (words one after another in ``word``): for each window of each segment in
    turn, the document and place of its earliest occurrence, and the windows' count per segment. A window
    whose interval in the index holds one suffix occurs nowhere else in the shard; others begin at the
    interval's first place."""
    order = np.lexsort((begin, doc))  # so that earlier in the text is earlier in the corpus
    ends = np.cumsum(n_words)
    _, code = np.unique(word, return_inverse=True)
    code = code.reshape(-1) + 1
    size = n_words[order]
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    at = np.cumsum(size + 1) - size - 1
    text[ragged(at, size)] = code[ragged((ends - n_words)[order], size)]
    index = FMIndex(text, SPAN)
    lo, hi = index.stream(text, at + size)
    windows = size - SPAN + 1
    own = ragged(at, windows)
    hit = np.where(hi[own] - lo[own] > 1, index.earliest(lo[own]), own)
    of = np.searchsorted(at, hit, side="right") - 1
    d, w = doc[order][of], begin[order][of] + hit - at[of]
    # Back to the given order.
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    pick = ragged((np.cumsum(windows) - windows)[back], windows[back])
    return d[pick], w[pick], windows[back]


def _by_window(held: DataFrame) -> DataFrame:
    """Answers (anchor, seg, docs, begins) for segments of hot anchors: each window's earliest place by window hash."""
    schema = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("step", pa.int32()), ("window", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, seg, doc, begin, windows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            lists = batch.column(5)
            h = gram_hashes(lists.flatten().to_numpy(zero_copy_only=False).view(U64), SPAN)
            heads = np.array(lists.offsets)[:-1] - lists.offsets[0].as_py()
            row = np.repeat(np.arange(len(windows)), windows)
            step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            made = (anchor[row], seg[row], step.astype(np.int32), h[heads[row] + step].view(np.int64), doc[row], (begin[row] + step).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], schema=schema)

    rows = runtime.cut(held.mapInArrow(runtime.lean(run), "anchor long, seg long, step int, window long, doc_id long, begin int"), "windows", free=True)
    first = runtime.cut(rows.groupBy("window").agg(F.min(F.struct("doc_id", "begin")).alias("place")), "first")
    steps = rows.select("anchor", "seg", "step", "window").distinct().join(first.hint("merge"), "window")
    listed = steps.groupBy("anchor", "seg").agg(F.sort_array(F.collect_list(F.struct("step", "place.doc_id", "place.begin"))).alias("s"))
    return listed.select("anchor", "seg", F.col("s.doc_id").alias("docs"), F.col("s.begin").alias("begins"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_removed, kept`` (the words left, joined by one space).

    A null text has no words. Documents of fewer than SPAN words lose nothing. Places are compared by
    doc_id, then start; rows that repeat a doc_id are one document's versions, judged together: a place
    found repeated in one of them is removed in all. An empty table gives no rows.
    """
    spark = docs.sparkSession
    runtime.tune(spark)
    source = runtime.texts(docs)
    fields = [("anchor", pa.int64()), ("seg", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int32()), ("windows", pa.int32())]

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, _, off, buf, _ in parts(batch.column(1)):
                starts, ends, first = words(buf, off)
                h = span_hashes(buf, starts, ends)
                row, begin, count, anchor = segments(first, h)
                at = first[row] + begin
                seg = run_hashes(h, at, at + count + SPAN - 1)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(ids[a + row]), pa.array(begin.astype(np.int32)), pa.array(count.astype(np.int32))], schema=pa.schema(fields))

    every = source.mapInArrow(runtime.lean(cut_up), "anchor long, seg long, doc_id long, begin int, windows int")
    # Written, so that the join reads both sides from plain shuffles and splits a common anchor.
    often = runtime.cut(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "often")
    repeated = runtime.cut(every.join(often.hint("merge"), "anchor"), "repeated", free=True)
    runtime.drop(often)
    distinct = runtime.cut(repeated.groupBy("anchor", "seg").agg(F.min(F.struct("doc_id", "begin")).alias("place"), F.min("windows").alias("windows")), "distinct", free=True)
    hot = runtime.cut(distinct.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("anchor"), "hot")
    content = pa.schema([*fields, ("words", pa.list_(pa.int64()))])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            heads = np.array(lists.offsets)
            flat = {n: lists.values.field(n).to_numpy(zero_copy_only=False) for n in ("anchor", "seg", "begin", "windows")}
            for a, b, off, buf, _ in parts(runtime.unsqueezed(batch.column(1))):
                starts, ends, first = words(buf, off)
                h = span_hashes(buf, starts, ends)
                pick = slice(heads[a], heads[b])
                row = np.repeat(np.arange(b - a), np.diff(heads[a : b + 1]))
                begin, windows = flat["begin"][pick].astype(np.int64), flat["windows"][pick].astype(np.int64)
                at, n = first[row] + begin, windows + SPAN - 1
                own = at + n <= first[row + 1]  # of rows that repeat an id, those that hold the segment
                own[own] = run_hashes(h, at[own], (at + n)[own]).view(np.int64) == flat["seg"][pick][own]
                at, n = at[own], n[own]
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h[ragged(at, n)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(flat["anchor"][pick][own]), pa.array(flat["seg"][pick][own]), pa.array(ids[a + row][own]), pa.array(begin[own].astype(np.int32)), pa.array(windows[own].astype(np.int32)), held], schema=content)

    packed = runtime.squeezed(source)  # texts cross the network for the segments' words and for the result

    def fetched(chosen: DataFrame) -> DataFrame:
        wanted = chosen.groupBy("place.doc_id").agg(F.collect_list(F.struct("anchor", "seg", F.col("place.begin").alias("begin"), "windows")).alias("wanted"))
        texts = packed.join(wanted.hint("merge"), "doc_id").select("doc_id", "packed", "wanted")
        return texts.mapInArrow(runtime.lean(fetch), "anchor long, seg long, doc_id long, begin int, windows int, words array<long>")

    answer = pa.schema([("anchor", pa.int64()), ("seg", pa.int64()), ("docs", pa.list_(pa.int64())), ("begins", pa.list_(pa.int32()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All segments of this task's anchors, which come in order, shard by shard."""
        held: list[pa.RecordBatch] = []
        words_held = 0
        for batch in batches:
            held.append(batch)
            words_held += len(batch.column(5).flatten())
            if words_held >= SHARD_WORDS:
                t = pa.Table.from_batches(held)
                anchor = t.column("anchor").to_numpy()
                end = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if end:
                    yield from answered(t.slice(0, end))
                held = t.slice(end).combine_chunks().to_batches()
                words_held = sum(len(b.column(5).flatten()) for b in held)
        if held:
            yield from answered(pa.Table.from_batches(held))

    def answered(t: pa.Table) -> Iterator[pa.RecordBatch]:
        # By anchor; rows that repeat an id can bring a segment twice.
        key = np.stack([t.column("anchor").to_numpy(), t.column("seg").to_numpy()])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        fresh = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))[: len(order)]
        order, anchor = order[fresh], key[0, fresh]
        size = t.column("windows").to_numpy()[order].astype(np.int64) + SPAN - 1
        head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
        shard = (np.cumsum(size) - size)[head] // SHARD_WORDS
        cuts = np.append(head[np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(head)])], len(order))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = t.take(pa.array(order[a:b])).combine_chunks()
            lists = own.column("words").combine_chunks()
            d, w, windows = earliest(own.column("doc_id").to_numpy(), own.column("begin").to_numpy().astype(np.int64), np.diff(np.array(lists.offsets)), lists.flatten().to_numpy())
            offsets = pa.array(np.concatenate([[0], np.cumsum(windows)]), pa.int32())
            made = pa.Table.from_arrays([own.column("anchor"), own.column("seg"), pa.ListArray.from_arrays(offsets, pa.array(d)), pa.ListArray.from_arrays(offsets, pa.array(w.astype(np.int32)))], schema=answer)
            yield from made.to_batches(max_chunksize=20_000)

    types = "anchor long, seg long, docs array<long>, begins array<int>"
    cool, split = distinct, None
    if not hot.isEmpty():
        cool, split = distinct.join(hot.hint("merge"), "anchor", "left_anti"), _by_window(fetched(distinct.join(hot.hint("merge"), "anchor", "left_semi")))
    answers = fetched(cool).repartition(runtime.partitions(spark), "anchor").sortWithinPartitions("anchor").mapInArrow(runtime.lean(index), types)
    answers = answers if split is None else answers.unionByName(split)
    # Written, so that the shuffles of the words go before texts are shuffled once more.
    answers = runtime.cut(answers, "answers", free=True)
    runtime.drop(distinct)
    marks = pa.schema([("doc_id", pa.int64()), ("begin", pa.int32()), ("mask", pa.int32())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, begin = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            heads = np.array(batch.column(2).offsets)
            n = np.diff(heads)
            row = np.repeat(np.arange(len(n)), n)
            step = np.arange(int(n.sum())) - np.repeat(heads[:-1] - heads[0], n)
            d, w = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(3).flatten().to_numpy(zero_copy_only=False)
            early = (d < doc[row]) | ((d == doc[row]) & (w < begin[row] + step))
            mask = np.bincount(row, early * (1 << step), len(n)).astype(np.int32)
            keep = mask > 0
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(begin[keep]), pa.array(mask[keep])], schema=marks)

    judged = repeated.join(answers, ["anchor", "seg"]).select("doc_id", "begin", "docs", "begins").mapInArrow(runtime.lean(judge), "doc_id long, begin int, mask int")
    by_doc = judged.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "mask")).alias("marks"))
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            heads = np.array(lists.offsets)
            begins, masks = (lists.values.field(n).to_numpy(zero_copy_only=False) for n in ("begin", "mask"))
            for a, b, off, buf, _ in parts(runtime.unsqueezed(batch.column(1))):
                starts, ends, first = words(buf, off)
                pick = slice(heads[a], heads[b])
                row = np.repeat(np.arange(b - a), np.diff(heads[a : b + 1]))
                cover = np.zeros(len(starts) + SPAN + 1, np.int64)
                for j in range(SPAN):
                    at = first[row] + begins[pick] + j
                    use = (masks[pick] >> j & 1).astype(bool) & (at + SPAN <= first[row + 1])
                    np.add.at(cover, at[use], 1)
                    np.add.at(cover, at[use] + SPAN, -1)
                gone = np.cumsum(cover)[: len(starts)] > 0
                counted = np.concatenate([[0], np.cumsum(gone)])
                kept = []
                raw = buf.tobytes()
                for i in range(b - a):
                    own = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
                    kept.append(b" ".join([raw[s:e] for s, e in zip(starts[own].tolist(), ends[own].tolist())]).decode())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(first)), pa.array(counted[first[1:]] - counted[first[:-1]]), pa.array(kept, pa.string())], schema=out)

    none = F.expr("cast(array() as array<struct<begin: int, mask: int>>)")
    joined = packed.join(by_doc.hint("merge"), "doc_id", "left").select("doc_id", "packed", F.coalesce("marks", none).alias("marks"))
    return joined.mapInArrow(runtime.lean(strike), "doc_id long, n_words long, n_removed long, kept string")

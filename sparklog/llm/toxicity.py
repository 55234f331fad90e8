"""Toxicity by bags of character n-grams.

Every n-gram of the words of a passage (``PASSAGE`` words in a row, a repeated word once, word
ends marked) has a vector; the passage's vector is their average by word, and a linear softmax over
it gives the class. Vectors and softmax are trained jointly, in numpy. A document's score
is that of its most toxic passage, so a few words in a long text count as much as in a
short one; this departs from one average for a whole document, in which a few words drown.
Training takes each document's highest passage in turn (the first round takes whole texts).
A fourth of the labelled texts takes no step; the round and the cut are those that tell it
apart best. Unseen misspellings share n-grams with the words they come from.

Only the difference of the two class logits matters, and it is linear in the n-gram
vectors: for scoring each n-gram is folded to one number, so a text costs a table look-up
for each n-gram and the model has a fixed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm import runtime
from sparklog.llm.kernels import LOWER, SPACES, parts, ragged

GRAMS = (3, 4, 5, 6)
BUCKET_BITS = 18
PASSAGE = 2
#: At most so many labelled documents of each class are trained on (those of lowest hash).
SAMPLE = 2500
#: And of each class at most so many bytes of text, whole texts in order of hash (the first in any case).
SAMPLE_BYTES = 8 << 20
#: A text without words scores the share of class 1, but so much at most.
EMPTY = 0.25
BATCH, BATCH_WORDS = 64, 20_000
DIM, EPOCHS, RATE = 8, 8, 0.5
#: A clean text rejected counts as much as so many toxic ones kept.
CLEAN = 2
#: Texts that must fill an n-gram's bucket (a fiftieth of the smaller class, if that is less), and texts of class 1 kept out of training that are enough to choose the cut.
LEAST_TEXTS, LEAST_JUDGES = 5, 5
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def grams(off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Words of rows as padded spans. Returns the words' count per row, for each n the positions'
    buckets and validity over the padded bytes, and the words' first and end bytes there."""
    rows = len(off) - 1
    size = np.diff(off)
    pad = np.full(len(buf) + rows + 1, 32, np.uint8)
    pad[ragged(off[:-1] + 1 + np.arange(rows), size)] = np.where(SPACES[buf], 32, LOWER[buf])
    white = pad == 32
    begin = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    end = np.flatnonzero(~white[:-1] & white[1:]) + 1
    per_row = np.diff(np.searchsorted(begin, np.append(off[:-1] + np.arange(rows), len(pad))))
    last = np.zeros(len(pad), np.int64)  # end of the word (with its mark) that begins or goes on here
    last[begin - 1] = end + 1
    room = np.maximum.accumulate(last) - np.arange(len(pad))
    room[:1] = room[:1]
    made = []
    wide = pad.astype(np.uint32)
    for n in GRAMS:
        total = np.zeros(max(0, len(pad) - n + 1), np.uint32)
        for i in range(n):
            total += wide[i : i + len(total)] * _MUL[i]
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D + 2 * n)
        made.append((total >> np.uint32(32 - BUCKET_BITS), room[: len(total)] >= n))
    return per_row, made, begin, end


def word_logits(table: np.ndarray, off: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the folded numbers of each word's n-grams, and the words' count per row."""
    per_row, made, begin, end = grams(off, buf)
    total, count = np.zeros(len(buf) + len(off) + 1), np.zeros(len(buf) + len(off) + 1)
    for bucket, valid in made:
        total[1 : len(bucket) + 1] += np.where(valid, table[bucket], 0)
        count[1 : len(bucket) + 1] += valid
    np.cumsum(total, out=total)
    np.cumsum(count, out=count)
    return (total[end] - total[begin - 1]) / np.maximum(count[end] - count[begin - 1], 1), per_row


def once(s: np.ndarray, per_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words' numbers with runs of one number in a row (a word that is repeated) as one."""
    row = np.repeat(np.arange(len(per_row)), per_row)
    keep = np.append(True, (s[1:] != s[:-1]) | (row[1:] != row[:-1]))[: len(s)]
    return s[keep], np.bincount(row[keep], minlength=len(per_row))


def passage_best(s: np.ndarray, per_row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest mean of ``width`` words in a row (of all, if fewer) of each row, and its first word; -inf for rows without words."""
    firsts = np.cumsum(per_row) - per_row
    sums = np.concatenate([[0.0], np.cumsum(s)])
    n = np.maximum(per_row - width + 1, np.minimum(per_row, 1))
    starts = ragged(firsts, n)
    ends = np.minimum(starts + width, np.repeat(firsts + per_row, n))
    mean = (sums[ends] - sums[starts]) / np.maximum(ends - starts, 1)
    best, at = np.full(len(per_row), -np.inf), np.zeros(len(per_row), np.int64)
    if len(mean):
        has = n > 0
        heads = (np.cumsum(n) - n)[has]
        best[has] = np.maximum.reduceat(mean, heads)
        hit = np.flatnonzero(mean == np.repeat(best[has], n[has]))
        row = np.searchsorted(np.cumsum(n), hit, side="right")
        at[row[::-1]] = starts[hit[::-1]]
    return best, at


class Model:
    """Folded n-gram numbers and the bias; ``score`` is the probability of class 1."""

    def __init__(self, table: np.ndarray, bias: float, bias_empty: float):
        self.table, self.bias, self.bias_empty = table, bias, bias_empty

    def score(self, off: np.ndarray, buf: np.ndarray) -> np.ndarray:
        s, per_row = once(*word_logits(self.table, off, buf))
        best, _ = passage_best(s, per_row, PASSAGE)
        z = np.where(np.isfinite(best), best + self.bias, self.bias_empty)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], labels: np.ndarray, seed: int = 5, counts: tuple[int, int] | None = None) -> Model:
    """Fit on whole texts; without both classes the score is the share of class 1.

    counts: how many labelled texts of class 0 and 1 the sample stands for (else itself). The share and the cut go by them."""
    y = np.asarray(labels, np.float64)
    held = np.bincount(y.astype(np.int64), minlength=2)
    stands = np.array(counts if counts is not None else held, np.float64)
    share = float(np.clip(stands[1] / stands.sum(), 0.01, 0.99)) if stands.sum() else 0.5
    prior = float(np.log(share / (1 - share)))
    empty = min(prior, float(np.log(EMPTY / (1 - EMPTY)))) if stands.sum() else prior  # no labels: no verdict
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BUCKET_BITS, np.float32), prior, empty)
    rng = np.random.default_rng(seed)
    # Each distinct word's n-grams, once.
    words, rows = {}, []
    for t in texts:
        row = np.array([words.setdefault(w, len(words)) for w in t.encode().lower().split()], np.int32)
        rows.append(row[np.append(True, row[1:] != row[:-1])[: len(row)]])
    names = list(words)
    ids, sizes = [], []
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        off = np.cumsum([0] + [len(w) for w in some])
        _, made, begin, end = grams(off, np.frombuffer(b"".join(some), np.uint8))
        key = np.concatenate([np.flatnonzero(v) for _, v in made])
        bucket = np.concatenate([b[v] for b, v in made]).astype(np.int32)
        owner = np.searchsorted(begin - 1, key, side="right")
        ids.append(bucket[np.argsort(owner, kind="stable")])
        sizes.append(np.bincount(owner - 1, minlength=len(some)))
    ids, sizes = np.concatenate(ids), np.concatenate(sizes)
    heads = np.cumsum(sizes) - sizes
    per_row = np.array([len(r) for r in rows])
    every = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    firsts = np.cumsum(per_row) - per_row
    # Buckets that few texts fill say nothing of other texts: their vectors stay 0.
    filled = np.zeros(1 << BUCKET_BITS, np.int32)
    for r in rows:
        own = np.unique(r)
        filled[np.unique(ids[ragged(heads[own], sizes[own])])] += 1
    usual = filled >= min(LEAST_TEXTS, max(1, int(held.min()) // 50))
    vec = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    vec[~usual] = 0
    soft = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2)
    g_vec, g_soft, g_bias = np.full((1 << BUCKET_BITS, 1), 1e-3, np.float32), np.full((DIM, 2), 1e-3), np.full(2, 1e-3)
    # Every fourth text with words of each class is kept out of the steps; they choose the round and the cut.
    known = np.flatnonzero(per_row)
    apart = np.concatenate([known[y[known] == k][3::4] for k in (0, 1)])
    judges = apart if (y[apart] == 1).sum() >= LEAST_JUDGES else known
    learn = np.setdiff1d(known, apart) if judges is apart else known
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    many = stands / held  # texts that one of the sample stands for
    chosen: tuple[float, np.ndarray, float] | None = None

    def folded() -> np.ndarray:
        return vec @ (soft[:, 1] - soft[:, 0])

    def word_scores() -> np.ndarray:
        # Every word has an n-gram, for its ends are marked.
        return np.add.reduceat(folded()[ids], heads).astype(np.float64) / sizes if len(heads) else np.zeros(0)

    for epoch in range(EPOCHS):
        if epoch == 0:
            begin, size = firsts, per_row
        else:
            _, begin = passage_best(word_scores()[every], per_row, PASSAGE)
            size = np.minimum(per_row - (begin - firsts), PASSAGE)
        order = rng.permutation(learn)
        upto = np.cumsum(size[order])
        at = 0
        while at < len(order):  # steps of BATCH texts, and of so many words that they stay small
            end = int(np.searchsorted(upto, upto[at] - size[order[at]] + BATCH_WORDS, side="right"))
            some = order[at : max(at + 1, min(end, at + BATCH))]
            at += len(some)
            w = every[ragged(begin[some], size[some])]
            doc = np.repeat(np.arange(len(some)), size[some])
            word_w = np.repeat(1 / size[some], size[some])
            gram = ids[ragged(heads[w], sizes[w])]
            g_doc = np.repeat(doc, sizes[w])
            g_w = np.repeat(word_w / np.maximum(sizes[w], 1), sizes[w]).astype(np.float32)
            g_w *= usual[gram]
            x = np.zeros((len(some), DIM))
            for k in range(DIM):
                x[:, k] = np.bincount(g_doc, vec[gram, k] * g_w, len(some))
            z = x @ soft + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), y[some].astype(int)] -= 1
            p *= weight[some][:, None]
            d_soft, d_bias, d_x = x.T @ p, p.sum(axis=0), p @ soft.T
            uniq, back = np.unique(gram, return_inverse=True)
            d_vec = np.stack([np.bincount(back, d_x[g_doc, k] * g_w, len(uniq)) for k in range(DIM)], axis=1)
            g_vec[uniq, 0] += (d_vec**2).mean(axis=1)
            g_soft += d_soft**2
            g_bias += d_bias**2
            vec[uniq] -= (RATE * d_vec / np.sqrt(g_vec[uniq])).astype(np.float32)
            soft -= (RATE * 0.2 * d_soft / np.sqrt(g_soft)).astype(np.float32)
            bias -= RATE * 0.2 * d_bias / np.sqrt(g_bias)
        # The cut at 0.5 goes where the judging texts are told apart best, each weighing what it stands for.
        best, _ = passage_best(word_scores()[every], per_row, PASSAGE)
        z, t = np.round(best[judges], 6), y[judges]  # sums of one passage's words differ in their last bits
        order = np.argsort(-z, kind="stable")
        wrong = many[1] * (t == 1).sum() + np.cumsum(np.where(t[order] == 1, -many[1], CLEAN * many[0]))  # if cut behind each
        wrong = np.where(np.append(z[order][1:] < z[order][:-1], False), wrong, np.inf)
        at = int(wrong.argmin())
        if np.isfinite(wrong[at]) and (chosen is None or wrong[at] <= chosen[0]):
            chosen = float(wrong[at]), folded().astype(np.float32), float(z[order[at]] + z[order[at + 1]]) / 2
    return Model(chosen[1], -chosen[2], empty) if chosen else Model(folded().astype(np.float32), 0.0, empty)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on labelled documents whose crc32(doc_id as text) mod 5 is not 0, at most ``sample`` and SAMPLE_BYTES of each class.

    Rows without a document or without a label take no part; of a document labelled twice each label counts. The classes'
    counts are taken over all labels of documents, not over the sample."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter((crc % 5 != 0) & F.col("toxic").isin(0, 1))
    chosen = None
    for k in (0, 1):
        some = usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2 * sample rows: small enough to send to every task, and to sum up in a window, whatever the input.
    rows = runtime.texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    upto = F.sum(F.octet_length("text")).over(order)
    rows = rows.withColumn("_upto", upto).withColumn("_turn", F.row_number().over(order)).filter((F.col("_upto") <= SAMPLE_BYTES) | (F.col("_turn") == 1)).select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r.doc_id, r.toxic, zlib.crc32(r.text.encode())))
    ids = runtime.texts(docs).select("doc_id")
    found = {r["toxic"]: r["count"] for r in usable.join(ids, "doc_id", "left_semi").groupBy("toxic").count().collect()}
    return train([r.text for r in rows], np.array([r.toxic for r in rows]), counts=(found.get(0, 0), found.get(1, 0)))


def scored(docs: DataFrame, model: Model, keep_below: float | None = None) -> DataFrame:
    """Scores of ``docs`` as ``doc_id, score`` (null text: empty; rows without an id left out; equal texts score alike); with ``keep_below``, the rows of ``docs`` themselves that score below it."""
    spark = docs.sparkSession
    runtime.tune(spark)
    held = spark.sparkContext.broadcast(model)  # 2 ** BUCKET_BITS numbers
    at = docs.columns.index("text") if keep_below is not None else 1
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.score(off, buf) for _, _, off, buf, _ in parts(batch.column(at), 1 << 19)]
            score = np.concatenate(got) if got else np.zeros(0)
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], schema=schema)
            else:
                yield batch.filter(pa.array(score < keep_below))

    if keep_below is None:
        return runtime.texts(docs).mapInArrow(runtime.lean(run), "doc_id long, score double")
    return docs.mapInArrow(runtime.lean(run), docs.schema)

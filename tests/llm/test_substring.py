"""FM-index and removal of repeated passages against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparklog.llm import queries, substring
from sparklog.llm.fm import FMIndex


def plain(rows):
    docs = sorted((d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows)
    first = {}
    for d, w in docs:
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (d, i))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone.update(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring.remove_repeats(df).collect())


def test_index_counts_and_streams():
    r = np.random.default_rng(0)
    texts = [r.integers(1, 4, int(n)) for n in r.integers(5, 60, 40)]
    text = np.concatenate([np.append(t, 0) for t in texts])
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    index = FMIndex(text, 7)
    other = np.concatenate([np.append(r.integers(1, 6, int(n)), 0) for n in r.integers(0, 60, 40)])
    for asked in (text, other):
        lo, hi = index.stream(asked, np.flatnonzero(asked == 0))
        for i in range(len(asked)):
            w = asked[i : i + 7]
            places = [j for j in range(len(text)) if len(w) == 7 and (w > 0).all() and np.array_equal(text[j : j + 7], w)]
            assert hi[i] - lo[i] == len(places)
            assert not places or index.earliest(lo[i : i + 1])[0] == places[0]


def test_index_is_compressed():
    r = np.random.default_rng(1)
    text = np.concatenate([np.append(r.integers(1, 30_000, 30), 0) for _ in range(8000)])
    assert FMIndex(text, 20).nbytes < 9 * len(text)


def test_result_comes_through_the_stream(spark, monkeypatch):
    """Without what backward search reports, nothing is found."""
    text = " ".join(map(str, range(60)))
    rows = [(1, text + " a"), (2, "b " + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == plain(rows)
    ids = np.array([1, 2]), np.array([0, 0]), np.array([20, 20]), np.tile(np.arange(20), 2)
    assert substring.earliest(*ids)[0].tolist() == [1, 1]
    monkeypatch.setattr(FMIndex, "stream", lambda self, t, e: (np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)))
    assert substring.earliest(*ids)[0].tolist() == [1, 2]


def test_equals_plain_version(spark):
    r = random.Random(6)
    word = lambda: r.choice(["a", "be", "Sea", "dé", "e,", "f.", "gg"]) + str(r.randrange(30))
    passages = [" ".join(word() for _ in range(r.choice([19, 20, 21, 50, 90]))) for _ in range(12)]
    rows = []
    for i in range(250):
        pieces = [" ".join(word() for _ in range(r.randrange(0, 40))) for _ in range(r.randrange(1, 5))]
        if r.random() < 0.7:
            pieces.insert(r.randrange(len(pieces) + 1), r.choice(passages))
        if r.random() < 0.1 and rows:
            pieces = [r.choice(rows)[1] or ""]
        rows.append((r.randrange(10**12) - 10**6, r.choice([" ", "\n", " \t "]).join(pieces)))
    rows += [(1, None), (2, ""), (3, " \n "), (4, "x " * 100), (5, "x " * 300), (6, "p q " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as anchor", "'x' as seg", "2 as begin").repartition(5)
    assert result(df) == plain(rows)


@pytest.mark.parametrize("hot", [1 << 13, 1])
def test_small_shards_and_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "SHARD_WORDS", 40)
    monkeypatch.setattr(substring, "HOT", hot)
    words = [str(i) for i in range(300)]
    rows = [(i, " ".join(words[(7 * i) % 100 : (7 * i) % 100 + 90])) for i in range(25)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op9_fm_index_repeats(spark, sf_dir).collect())) == plain(rows)


def test_repeated_and_empty(spark, no_docs):
    text = " ".join(map(str, range(50)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (1, "short")], "doc_id long, text string")
    assert [(d, n, g) for d, n, g, _ in result(df)] == [(1, 1, 0), (1, 50, 0), (1, 50, 0), (2, 50, 50)]
    assert substring.remove_repeats(no_docs).count() == 0

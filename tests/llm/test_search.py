"""Nearest neighbours and decontamination against brute force."""

import random
import re
import tracemalloc
import unicodedata

import numpy as np
import pytest

from sparklog.llm import ann, decontam, queries


def brute(ids, x, asked, k):
    out = {}
    for i in asked:
        s = np.add.reduce(x * x[np.flatnonzero(ids == i)[0]], axis=1)
        keep = ids != i
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(i)] = ids[keep][order].tolist()
    return out


def test_neighbours_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, ids[ids % 20 == 0], 20)
    got = {}
    for r in queries.op3_projected_kd_neighbours(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want)
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits >= 0.95 * 20 * len(want)


def test_neighbours_clustered_and_uneven_norms():
    r = np.random.default_rng(2)
    x = np.vstack([c + 0.2 * r.normal(size=(400, 24)) for c in r.normal(size=(12, 24))]) * r.uniform(0.5, 2, (4800, 1))
    ids = r.permutation(4800) * 3
    q = ids[:200]
    got = {}
    cell = ann.cell_of(ids, x, float((x * x).sum(axis=1).max()))
    for a, b, _ in zip(*cell.ask(q, x[:200], 20)):
        got.setdefault(int(a), []).append(int(b))
    want = brute(ids, x, q, 20)
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.9


def test_neighbours_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(60, None), (61, []), (62, [0.0, 0.0]), (63, [float("nan"), 1.0]), (64, [None, 1.0]), (65, [float("inf"), 0.0]), (66, [1.0, 2.0, 3.0]), (67, [0.5, 0.5]), (67, [0.5, 0.5]), (40, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as rank", "'x' as score")
    got = {}
    for r in ann.nearest(df, ann.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got[40] == [(i + 1, i, 1.0) for i in range(20)]
    assert got[0] == [(i, i, 1.0) for i in range(1, 21)] and 60 not in got
    assert ann.nearest(df.filter("vec_id >= 60"), ann.F.col("vec_id") % 20 == 0).count() == 0
    few = ann.nearest(df.filter("vec_id in (20, 67, 3)"), ann.F.col("vec_id") == 20).collect()
    assert [(r.rank, r.vec_id) for r in sorted(few)] == [(1, 3), (2, 67)]


def test_neighbours_over_cells(spark, monkeypatch):
    """Many cells: all queries against brute force, whatever cells their neighbours lie in; a third of all rows have one vector."""
    monkeypatch.setattr(ann, "CELL_ROWS", 200)
    r = np.random.default_rng(3)
    x = np.vstack([c + 0.3 * r.normal(size=(150, 12)) for c in r.normal(size=(20, 12))]) * r.uniform(0.5, 2, (3000, 1))
    x[::3] = x[0]
    ids = r.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for row in ann.nearest(df, ann.F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    want = brute(ids, x, ids[ids % 20 == 0], 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 20 for i in want]) >= 0.95


def test_upper_tree_covers_all_points():
    r = np.random.default_rng(0)
    upper = ann.Upper(r.normal(size=(500, 4)), 16)
    p = 3 * r.normal(size=(2000, 4))
    cell, bound = upper.cell(p), upper.bounds(p)
    assert len(upper.low) == 16 and (bound[np.arange(2000), cell] == 0).all() and ((bound == 0).sum(axis=1) == 1).all()
    assert len(ann.Upper(np.ones((50, 4)), 16).low) == 1


def test_recall_and_leaves_visited_at_twenty_thousand_rows():
    """Clustered vectors of 64 components: the test ends searches early and loses little. Unclustered ones it cannot end early."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(200, 64))
    x = np.repeat(centres, 100, axis=0) + 0.3 * r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, asked = np.arange(20_000), np.arange(0, 20_000, 100)
    cell = ann.cell_of(ids, x, 1.0)
    got = {}
    for a, b, _ in zip(*cell.ask(asked, x[asked], 20)):
        got.setdefault(int(a), []).append(int(b))
    want = brute(ids, x, asked, 20)
    assert np.mean([len(set(got[int(i)]) & set(want[int(i)])) / 20 for i in asked]) >= 0.95
    assert cell.visited < 0.5 * len(asked) * len(cell.leaves)


def test_chi_square_point():
    assert ann.chi_square_point(0.95, 8) == pytest.approx(15.5073, abs=1e-3)


def distance(a: str, b: str) -> int:
    """Least edits of the whole of ``a`` against any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a):
        new = [i + 1]
        for j, d in enumerate(b):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def norm(s):
    def one(c):
        n = ord(c)
        if n < 0x80:
            return c.lower() if c.isalnum() else " "
        if n < 0x800:
            low = c.lower()
            return (low if len(low) == 1 and 0x80 <= ord(low) < 0x800 else c) if c.isalnum() or unicodedata.category(c)[0] == "M" else " "
        return " " if 0x2000 <= n < 0x2080 or 0x3000 <= n < 0x3040 else c

    return re.sub(" +", " ", "".join(map(one, s))).strip(" ")


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        i = r.randrange(len(s))
        kind = r.randrange(3)
        if kind == 0:
            s[i] = r.choice("qzxj")
        elif kind == 1:
            s.insert(i, r.choice("qzxj"))
        else:
            del s[i]
    return "".join(s)


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice(["er", "th", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.randint(8, 40))) for i in range(12)]
    docs = []
    for i in range(60):
        body = text(r.randint(0, 80))
        if i % 2:
            item = items[i % 12][1]
            body += " " + edited(r, item, r.randint(0, int(0.12 * len(item)))) + " " + text(20)
        docs.append((i, body))
    got = {(x.doc_id, x.item_id): x for x in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    texts = dict(docs)
    for i, item in items:
        a = norm(item)
        for d, body in docs:
            edits = distance(a, norm(body)) if body else len(a)
            budget = min(int(0.08 * len(a)), (len(a) - decontam.Q) // decontam.Q)
            assert ((d, i) in got) == (edits <= budget), (d, i, edits, budget)
            if (d, i) in got:
                x = got[(d, i)]
                assert x.edits == edits
                assert distance(norm(texts[d][x.start : x.end]), a) <= edits


def test_leaks_of_a_benchmark_in_several_blocks(spark, monkeypatch):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))
    items = [(i, text(12)) for i in range(30)]
    docs = [(i, f"{text(20)} {items[i][1] if i < 30 else ''} {text(20)} {items[29 - i][1] if i < 30 else ''}") for i in range(40)]
    bench, table = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, decontam.leaks(table, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    assert len(decontam._indexes(spark, bench, "item_id", "text")) > 5
    assert sorted(map(tuple, decontam.leaks(table, bench).collect())) == want and {w[:2] for w in want} >= {(i, j) for i in range(30) for j in (i, 29 - i)}
    assert sorted(x.doc_id for x in decontam.drop_leaks(table, bench).collect()) == list(range(30, 40))


def test_leaks_query_finds_verbatim_items(spark, sf_dir):
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: norm(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, s in items.items() if s in t}
    got = {(r.doc_id, r.item_id) for r in queries.op7_qgram_decontamination(spark, sf_dir).collect()}
    assert want and want <= got and len(got) <= len(want) * 1.2 + 2


def test_leaks_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "tiny"), (4, "naïve alpha Beta, gamma. it's gamma 12.5 東京")], "item_id long, text string")
    assert decontam.leaks(odd_docs, bench).filter("item_id < 4").count() == 0
    assert decontam.leaks(no_docs, bench).count() == 0
    assert decontam.leaks(odd_docs, bench.limit(0)).count() == 0
    assert decontam.drop_leaks(odd_docs, bench).columns == odd_docs.columns
    planted = spark.createDataFrame([(1, "xx Naïve ALPHA beta gamma it s gamma 12 5 東京 yy"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    hit = decontam.leaks(planted, bench).collect()
    assert [(r.doc_id, r.item_id, r.edits, r.start) for r in hit] == [(1, 4, 0, 3)]
    assert sorted(r.doc_id for r in decontam.drop_leaks(planted, bench).collect()) == [2, 3]


def test_leaks_fold_case_and_typographic_signs(spark):
    bench = spark.createDataFrame([(1, "L'élève répète : « où est l'été ? » - il n'a pas de réponse")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "X L\u2019ÉLÈVE RÉPÈTE\u00a0: \u201coù est l\u2019été\u00a0?\u201d \u2014 il n\u2019a pas de RÉPONSE."), (1, "X L\u2019ÉLÈVE RÉPÈTE\u00a0: \u201coù est l\u2019été\u00a0?\u201d \u2014 il n\u2019a pas de RÉPONSE.")], "doc_id long, text string").withColumn("item_id", decontam.F.lit("x"))
    assert [(r.doc_id, r.item_id, r.edits, r.start) for r in decontam.leaks(docs, bench).collect()] == [(1, 1, 0, 2)] * 2


def test_leaks_of_repetitive_texts_are_exact_and_bounded():
    r = random.Random(8)
    items = [(0, "na " * 200), (1, "na na no " * 60), (2, "nana " * 100 + "batman " * 5)]
    index = decontam.Index(items)
    texts = ["na " * 700, "na na no " * 90 + "na " * 50, edited(r, "na " * 200, 12), "na " * 150, "nana " * 99 + "batman " * 5, "xyz " * 300]
    raw = [t.encode() for t in texts]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    got = {(a, b): e for a, b, e, _, _ in index.matches(off, buf)}
    for row, t in enumerate(texts):
        for i, item in items:
            a = norm(item)
            edits, budget = distance(a, norm(t)), min(int(0.08 * len(a)), (len(a) - decontam.Q) // decontam.Q)
            assert got.get((row, i)) == (edits if edits <= budget else None), (row, i, edits)
    raw = b"na " * 333_000 + b"no"
    tracemalloc.start()
    assert {(i, e) for _, i, e, _, _ in index.matches(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8))} == {(0, 0)}
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()

"""The prefix-tree join against all pairs."""

import random
import re

import numpy as np
import pytest

from sparklog.llm import jaccard
from sparklog.llm.components import components


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def brute(rows, n, num, den):
    sets = [(d, shingles(t, n)) for d, t in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets))


def corpus(r, n, boiler=True):
    word = lambda: r.choice("abcdefgh") + r.choice("xyz") + str(r.randrange(40))
    line = " ".join(word() for _ in range(30))
    rows, bases = [], []
    for i in range(n):
        if bases and r.random() < 0.6:
            w = r.choice(bases).split()
            for _ in range(r.randrange(0, max(2, len(w) // 12))):
                k = r.randrange(len(w))
                w[k : k + r.randrange(2)] = [word()] * r.randrange(2)
            text = " ".join(w)
        else:
            text = " ".join(word() for _ in range(r.choice([1, 2, 3, 8, 20, 60, 150, 400])))
            bases.append(text)
        if boiler and r.random() < 0.3:
            text += " " + line
        rows.append((r.randrange(10**9), text.upper() if r.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (2, 70, 100), (2, 50, 100)])
def test_groups_equal_all_pairs(spark, n, num, den):
    rows = corpus(random.Random(n), 400) + [(5, None), (6, ""), (7, " \n"), (8, "one"), (9, "one"), (10, "one two"), (3, "ONE")]
    rows += [rows[10], rows[10]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as lo", "'x' as rep", "2 as root").repartition(5)
    got = sorted(map(tuple, jaccard.groups(df, n, num, den).collect()))
    assert got == brute(rows, n, num, den)
    kept = jaccard.keep_one(df, n, num, den)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in got})


@pytest.mark.parametrize("cell", [150, 2000])
def test_groups_over_many_cells(spark, monkeypatch, cell):
    """Trees for single elements, and pairs of chunks."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    monkeypatch.setattr(jaccard, "CROWD", 2)
    rows = corpus(random.Random(9), 300, boiler=False)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.groups(df, 2, 60, 100).collect())) == brute(rows, 2, 60, 100)


def test_family_that_one_pivot_does_not_link(spark, monkeypatch):
    """Variants of one text, most pairs of them below the threshold: chains link them. With and without more pivots, whole and in chunks."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(120), r.randint(0, 7)):
            w[k] = f"v{i}x{k}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 80, 100)
    assert 1 < len({c for _, _, c in want}) < 100
    for cell, turns in ((1 << 19, 3), (2000, 0), (1000, 2)):
        monkeypatch.setattr(jaccard, "CELL", cell)
        monkeypatch.setattr(jaccard, "TURNS", turns)
        monkeypatch.setattr(jaccard, "CROWD", 20)
        assert sorted(map(tuple, jaccard.groups(df, 3, 80, 100).collect())) == want


def test_keep_one_of_repeated_ids_and_without_id(spark):
    a, b, c = "one two three four five six seven", "x1 x2 x3 x4 x5 x6 x7", "y1 y2 y3 y4 y5 y6"
    rows = [(1, a, "p"), (2, a, "q"), (2, b, "r"), (2, b, "r"), (3, b, "s"), (4, c, "t"), (4, "", "u"), (4, None, "v"), (None, a, "w"), (None, None, None), (5, c, "z")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _n string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [(1, a, "p"), (2, b, "r"), (4, c, "t"), (4, "", "u"), (4, None, "v"), (None, a, "w"), (None, None, None)]))


def test_tree_join_connects_as_all_pairs():
    r = np.random.default_rng(4)
    for trial in range(30):
        base = [r.choice(3000, int(r.integers(1, 120)), replace=False) for _ in range(6)]
        sets = []
        for _ in range(60):
            b = base[int(r.integers(6))]
            s = set(b[r.random(len(b)) > 0.06 * r.random()].tolist()) | set(r.choice(3000, int(r.integers(0, 1 + len(b) // 12))).tolist())
            sets.append(sorted(s) or [1])
        value = np.concatenate([np.array(s, np.uint64) for s in sets])
        size = np.array([len(s) for s in sets])
        links = jaccard.tree_join(value, size, 90, 100)
        for a, b in links:
            x, y = set(sets[a]), set(sets[b])
            assert 100 * len(x & y) >= 90 * len(x | y)
        f = jaccard.Forest(np.arange(60))
        for a, b in links:
            f.join(a, b)
        for i in range(60):
            for j in range(i):
                x, y = set(sets[i]), set(sets[j])
                if 100 * len(x & y) >= 90 * len(x | y):
                    assert f.label[i] == f.label[j], trial


def test_empty_table(spark, no_docs):
    assert jaccard.groups(no_docs).count() == 0
    assert jaccard.keep_one(no_docs).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (200, 200)] + [(300, 301 + i) for i in range(50)] + [(r.randrange(1000, 1040), r.randrange(1000, 1040)) for _ in range(25)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        return i if parent[i] == i else find(parent[i])

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

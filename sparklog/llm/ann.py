"""Nearest neighbours through low-dimensional stable projections.

Vectors are lifted by one component to one common norm, so that the largest inner
product is the least Euclidean distance. Lifted vectors are projected on ``M`` Gaussian
(2-stable) directions. The upper part of a kd-tree over the projections, fitted on a
bounded sample, deals all rows to cells; each cell has a tree of its own. A query
takes a cell's leaves in order of projected distance and verifies their vectors by
their true inner product. The squared projected distance of a vector at distance d is
d^2 times a chi-square variable of M degrees of freedom; so once the next leaf lies at a
projected distance whose chi-square probability against the k-th best distance reaches
``CERTAINTY``, a nearer vector would have been met with that probability, and it stops.

Every row is indexed, once: rows of equal vectors as one entry with their k+1 least ids. A
query asks the cell it lies in first; with the k-th distance found there, the same test
says which other cells it must ask. A task holds one cell and streams its queries through
it, so neither rows nor queries are copied for one another; a cell gets the queries that need it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm import runtime
from sparklog.llm.kernels import ragged

M = 8
CERTAINTY = 0.97
LEAF = 64
#: Rows of a cell on average (fewer, if there would not be work for all tasks), and at least.
CELL_ROWS, LEAST_ROWS = 1 << 16, 1 << 13
#: The upper tree is fitted on so many rows at most, and so many bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
SEED = 17


def chi_square_point(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        x = (lo + hi) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if 1 - tail < p else (lo, x)
    return hi


class Tree:
    """kd-tree over projected points: leaves of about LEAF points with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        cuts = [0, len(points)]
        while len(points) and max(np.diff(cuts)) > leaf:
            made = [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a > leaf:
                    own = points[self.order[a:b]]
                    axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
                    half = (b - a) // 2
                    self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], half)]
                    made.append(a + half)
                made.append(b)
            cuts = made
        self.cuts = np.array(cuts)
        heads = self.cuts[:-1]
        own = points[self.order]
        self.low = np.minimum.reduceat(own, heads, axis=0) if len(points) else np.zeros((0, points.shape[1]))
        self.high = np.maximum.reduceat(own, heads, axis=0) if len(points) else np.zeros((0, points.shape[1]))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to each leaf's box."""
        out = np.zeros((len(q), len(self.low)))
        for j in range(q.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, j] - q[:, j, None], q[:, j, None] - self.high[:, j]), 0)
            out += gap * gap
        return out


class Upper:
    """The upper part of the kd-tree: halves of a sample by median until there are about ``cells``; its cells cover all space."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis, self.cut, self.child = [], [], []  # of inner nodes; a child below 0 is cell -1 - child
        self.low, self.high = [], []
        depth = max(0, cells - 1).bit_length()
        m = points.shape[1]
        self.root = self._grow(points, depth, np.full(m, -np.inf), np.full(m, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, depth: int, low: np.ndarray, high: np.ndarray) -> int:
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(len(low))
        axis = int(spread.argmax())
        if not depth or not spread[axis] > 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        cut = float(np.median(points[:, axis]))
        if not (points[:, axis] < cut).any():  # most are the least value
            cut = float(points[points[:, axis] > cut, axis].min())
        node = len(self.axis)
        self.axis.append(axis)
        self.cut.append(cut)
        self.child.append((0, 0))
        below, above = high.copy(), low.copy()
        below[axis], above[axis] = cut, cut
        left = points[:, axis] < cut
        self.child[node] = self._grow(points[left], depth - 1, low, below), self._grow(points[~left], depth - 1, above, high)
        return node

    def cell(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point, by descending the tree."""
        at = np.full(len(points), self.root)
        axis, cut, child = np.array(self.axis, np.int64), np.array(self.cut), np.array(self.child, np.int64).reshape(-1, 2)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = child[node, (points[inner, axis[node]] >= cut[node]).astype(np.int64)]
        return -1 - at

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each point to each cell."""
        out = np.zeros((len(q), len(self.low)))
        for j in range(q.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, j] - q[:, j, None], q[:, j, None] - self.high[:, j]), 0)
            out += gap * gap
        return out


def axes_of(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(dim + 1, m))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, all of squared norm ``top`` (the largest of all vectors)."""
    return np.hstack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]])


class Cell:
    """Distinct vectors with the ids that have them (one after another in ``member``, ``sizes`` of each), and a kd-tree over their projections."""

    def __init__(self, x: np.ndarray, member: np.ndarray, sizes: np.ndarray, top: float, m: int = M, certainty: float = CERTAINTY):
        self.x, self.member, self.sizes, self.top = x, member, sizes, top
        self.heads = np.cumsum(sizes) - sizes
        self.axes = axes_of(x.shape[1], m)
        self.tree = Tree(lifted(x, top) @ self.axes)
        self.point = chi_square_point(certainty, m)
        self.leaves = [self.tree.order[a:b] for a, b in zip(self.tree.cuts[:-1], self.tree.cuts[1:])]
        self.visited = 0

    def ask(self, q_ids: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query its k nearest by inner product, as found: query ids, ids, scores. bar: a score that its
        k-th best elsewhere has (less is of no use)."""
        found: list[list[np.ndarray]] = [[], [], []]
        bar = np.full(len(q), -np.inf) if bar is None else bar
        for a in range(0, len(q), 256):
            for out, got in zip(found, self._some(q_ids[a : a + 256], q[a : a + 256], k, bar[a : a + 256])):
                out += got
        return tuple(np.concatenate(f) if f else np.zeros(0, t) for f, t in zip(found, (np.int64, np.int64, np.float64)))

    def _some(self, q_ids: np.ndarray, qs: np.ndarray, k: int, bar: np.ndarray) -> tuple[list, list, list]:
        bound = self.tree.bounds(qs @ self.axes[:-1])
        near = np.argsort(bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, near, axis=1)
        q_norm = (qs * qs).sum(axis=1)
        best = np.full((len(qs), k + 1), -np.inf)
        best_at = np.full((len(qs), k + 1), -1, np.int64)
        widest = max(map(len, self.leaves), default=0)

        def open_at(rows: np.ndarray, at: int) -> np.ndarray:
            worst = np.maximum(best[rows].min(axis=1), bar[rows])  # of k+1, one of which may be the query's own row
            distance = np.where(np.isfinite(worst), np.maximum(q_norm[rows] + self.top - 2 * worst, 0), np.inf)
            return rows[bound[rows, at] < self.point * distance]

        at, step = 0, 4
        active = open_at(np.arange(len(qs)), 0) if self.leaves else np.zeros(0, np.int64)
        while len(active):
            upto = min(at + step, len(self.leaves))
            width = upto - at
            self.visited += width * len(active)
            score = np.full((len(active), width * widest), -np.inf)
            place = np.full((len(active), width * widest), -1, np.int64)
            turn = near[active, at:upto]
            for leaf in np.unique(turn):
                r, slot = np.nonzero(turn == leaf)
                own_rows = self.leaves[leaf]
                cols = slot[:, None] * widest + np.arange(len(own_rows))
                score[r[:, None], cols] = qs[active[r]] @ self.x[own_rows].T
                place[r[:, None], cols] = own_rows
            score = np.hstack([best[active], score])
            place = np.hstack([best_at[active], place])
            pick = np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, : k + 1]
            best[active] = np.take_along_axis(score, pick, axis=1)
            best_at[active] = np.take_along_axis(place, pick, axis=1)
            at, step = upto, step * 2
            active = open_at(active, at) if at < len(self.leaves) else active[:0]
        out: tuple[list, list, list] = ([], [], [])
        for i in range(len(qs)):
            got = best_at[i][best_at[i] >= 0]
            exact = np.add.reduce(self.x[got] * qs[i], axis=1)  # in one order for every row, so equal vectors tie
            n = np.minimum(self.sizes[got], k + 1)
            member = self.member[ragged(self.heads[got], n)]
            s = np.repeat(exact, n)
            keep = (member != q_ids[i]) & (s >= bar[i])
            member, s = member[keep], s[keep]
            rank = np.lexsort((member, -s))[:k]
            out[0].append(np.full(len(rank), q_ids[i]))
            out[1].append(member[rank])
            out[2].append(s[rank])
        return out


def cell_of(ids: np.ndarray, x: np.ndarray, top: float, **how) -> Cell:
    """A cell over rows, equal vectors as one."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1])))[:, 0]
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    pair = np.unique(np.stack([group.reshape(-1), ids], axis=1), axis=0)  # repeated rows count once
    return Cell(x[first], pair[:, 1], np.bincount(pair[:, 0]), top, **how)


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(v, lambda c: c != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v")).filter(F.coalesce(ok, F.lit(False)))


def nearest(rows: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest found of each query row among all rows but those of its id: ``query_id, rank, vec_id, score``.

    Rows without an id and vectors that are null, empty, zero, or hold null or non-finite numbers take no part, nor do
    those of another length than most have (of equally frequent lengths, the least). ``is_query``
    is a condition on ``vec_id``.
    """
    spark = rows.sparkSession
    runtime.tune(spark)
    usable = _usable(rows, id_col, vector_col)
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    sizes = usable.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max(square).alias("top")).orderBy(F.desc("n"), "dim").first()
    if sizes is None or not sizes.q:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, top, dim = sizes.n, sizes.top, sizes.dim
    usable = usable.filter(F.size("v") == dim)
    upper = _upper(usable, n, dim, top)
    axes, point = axes_of(dim), chi_square_point(CERTAINTY, M)
    # Equal vectors are one entry with their k+1 least ids; a limit by rank goes before the shuffle.
    least = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = usable.withColumn("_rank", least).filter(F.col("_rank") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = upper.cell(lifted(_matrix(batch.column(0), dim), top) @ axes)
            yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), batch.column(1), batch.column(0), pa.nulls(batch.num_rows, pa.float64())], names=["cell", "ids", "v", "bar"])

    columns = "cell int, ids array<long>, v array<double>, bar double"
    indexed = runtime.cut(entries.select("v", "ids").mapInArrow(placed, columns), "indexed")
    asked = usable.filter(is_query).distinct()
    first = asked.select("v", F.array("vec_id").alias("ids")).mapInArrow(placed, columns).withColumn("bar", F.lit(float("-inf")))
    found = _answers(indexed, first, dim, top, k)
    if len(upper.low) > 1:
        found = runtime.cut(found, "found")
        bars = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        bars = asked.join(bars.hint("merge"), F.col("vec_id") == F.col("query_id"), "left").select("v", F.array("vec_id").alias("ids"), F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("bar"))

        def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q, bar = _matrix(batch.column(0), dim), batch.column(2).to_numpy()
                distance = np.where(np.isfinite(bar), np.maximum((q * q).sum(axis=1) + top - 2 * bar, 0), np.inf)
                # The query's own lift is 0 here, as in its search; the cell it asked first is that of the lifted point.
                need = upper.bounds(q @ axes[:-1]) < point * distance[:, None]
                need[np.arange(len(q)), upper.cell(lifted(q, top) @ axes)] = False
                row, cells = np.nonzero(need)
                for at in range(0, len(row), 1000):
                    r = pa.array(row[at : at + 1000])
                    yield pa.RecordBatch.from_arrays([pa.array(cells[at : at + 1000].astype(np.int32)), batch.column(1).take(r), batch.column(0).take(r), batch.column(2).take(r)], names=["cell", "ids", "v", "bar"])

        found = found.unionByName(_answers(indexed, bars.mapInArrow(elsewhere, columns), dim, top, k))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _upper(usable: DataFrame, n: int, dim: int, top: float) -> Upper:
    cells = max(-(-n // CELL_ROWS), min(runtime.partitions(usable.sparkSession), n // LEAST_ROWS), 1)
    rows = min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)) if cells > 1 else 0
    axes = axes_of(dim)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = lifted(_matrix(batch.column(0), dim), top) @ axes
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(points.reshape(-1)), M).cast(pa.list_(pa.float64()))], names=["p"])

    chosen = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).select("v").mapInArrow(project, "p array<double>")
    sample = [r.p for r in chosen.collect()] if rows else []  # M numbers a row
    return Upper(np.array(sample, float).reshape(-1, M), cells)


def _answers(indexed: DataFrame, asked: DataFrame, dim: int, top: float, k: int) -> DataFrame:
    """``query_id, vec_id, score`` of the k best that each asked cell finds: in a task, cells one by one, and each cell's queries in batches."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, cell = -1, None
        for batch in batches:
            own, asks = batch.column(0).to_numpy(), batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (asks[1:] != asks[:-1])))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)]):
                part = batch.slice(a, b - a)
                if own[a] != number:
                    number, cell = own[a], None
                    held.clear()
                if not asks[a]:
                    held.append(part)
                    continue
                if cell is None and held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    held.clear()
                    ids = t.column("ids").combine_chunks()
                    cell = Cell(_matrix(t.column("v").combine_chunks(), dim), ids.flatten().to_numpy(), np.diff(np.array(ids.offsets)), top)
                if cell is not None:
                    got = cell.ask(part.column(1).flatten().to_numpy(), _matrix(part.column(2), dim), k, part.column(3).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(got, schema)], schema=schema)

    both = indexed.unionByName(asked).repartition(runtime.partitions(indexed.sparkSession), "cell")
    return both.sortWithinPartitions("cell", F.col("bar").isNotNull()).mapInArrow(run, "query_id long, vec_id long, score double")

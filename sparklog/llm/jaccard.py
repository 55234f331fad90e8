"""Groups of documents whose n-gram sets are alike, by a prefix-tree join in one global order.

Two sets link when ``den * |A and B| >= num * |A or B|``; the result is exact at every threshold.

1. A set is its 64-bit shingle hashes. Documents of equal sets form a class (by a 128-bit
   digest), and one of each class goes on.
2. The global order is by document frequency, rarest first, then by hash. Chunks of some
   megabytes of text send their distinct hashes, packed, to buckets of the hash space; a
   bucket counts them and sends a rank for each back to its chunk.
3. Sets that link share an element of their prefixes (the first ``n - least overlap + 1``
   elements in the global order). Elements of one document link nothing, so a document whose
   prefix holds only such elements ends here: most do.
4. Documents are compared with one pivot per prefix element first (some more where an element
   has many), which links families of near copies in linear work. Elements whose documents are
   all linked by then are done.
5. What is left meets in prefix trees: a set walks the tree along the leaves with which it
   shares an element of its prefix; branches share the overlap counted so far and are cut as
   soon as more elements are missing than the remaining length leaves. Sets that links
   connect already are not compared again. A tree holds the documents that shared elements
   connect. If those are more than CELL elements, each of their elements has its own tree
   or they are cut into chunks, whichever copies less; chunks of the largest component so far
   meet the chunks of the rest, not each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparklog.llm import runtime
from sparklog.llm.components import components
from sparklog.llm.kernels import BASE, LOWER, MIX_B, U64, gram_hashes, mix, parts, ragged, span_hashes, words

#: Elements that one task holds in a prefix tree.
CELL = 1 << 19
#: Elements of more documents than CROWD, which no cell holds, get up to TURNS more pivots before trees are built.
CROWD, TURNS = 1 << 12, 3
#: Elements that a bucket of the hash space holds on average, and bytes of text of a chunk, and of texts hashed at once.
BUCKET, CHUNK, PART = 1 << 20, 2 << 20, 1 << 19


def ordered_by(row: np.ndarray, rows: int, value: np.ndarray) -> np.ndarray:
    """An order by row, then value: one sort of both in 64 bits, where no two values of a row agree in all bits that fit."""
    bits = int(max(rows - 1, 0)).bit_length()
    key = value if not bits else (row.astype(U64) << U64(64 - bits)) | (value >> U64(bits))
    order = np.argsort(key)
    key, value = key[order], value[order]
    if bits and ((key[1:] == key[:-1]) & (value[1:] != value[:-1])).any():
        return np.lexsort((value[np.argsort(order)], row))
    return order


def shingle_sets(off: np.ndarray, buf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each row (A-Z lower-cased), sorted by row, then hash, and their
    count per row. Fewer words than n: the whole sequence as one; none: an empty set."""
    buf = LOWER[buf]
    starts, ends, first = words(buf, off)
    h = span_hashes(buf, starts, ends)
    per_row = np.diff(first)
    grams = gram_hashes(h, n)
    count = np.maximum(per_row - n + 1, 0)
    row = np.repeat(np.arange(len(per_row)), count)
    value = grams[ragged(first[:-1], count)]
    for k in range(1, n):  # sequences of k words, fewer than n
        short = np.flatnonzero(per_row == k)
        if len(short):
            total = np.full(len(short), k, U64)
            for i in range(k):
                total = total * BASE + h[first[short] + i]
            row = np.concatenate([row, short])
            value = np.concatenate([value, mix(total ^ MIX_B)])
    order = ordered_by(row, len(per_row), value)
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    return value, np.bincount(row, minlength=len(per_row))


def digests(value: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit digest of each set, in two halves."""
    ends = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value ^ BASE), dtype=U64)])
    other = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value + MIX_B), dtype=U64)])
    b = np.cumsum(size)
    a = b - size
    return mix(ends[b] - ends[a] + size.astype(U64)).view(np.int64), mix(other[b] - other[a] ^ size.astype(U64)).view(np.int64)


def least_overlap(n, num: int, den: int):
    """Elements that a set of n shares at least with any set it links with."""
    return -(-num * n // den)


class Forest:
    """Components by label; the smaller side is relabelled."""

    def __init__(self, label: np.ndarray):
        self.label = np.array(label)
        self.members: dict[int, list[int]] = {}
        for i, x in enumerate(self.label.tolist()):
            self.members.setdefault(x, []).append(i)

    def join(self, a: int, b: int) -> None:
        x, y = int(self.label[a]), int(self.label[b])
        if x == y:
            return
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        moved = self.members.pop(y)
        self.label[moved] = x
        self.members[x] += moved


def tree_join(value: np.ndarray, size: np.ndarray, num: int, den: int, rank: np.ndarray | None = None, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect exactly the sets that all links connect.

    rank: of each element, its place in the global order before the hash (else its frequency here).
    side: only pairs across sides count. label: sets of one label are connected already."""
    n = len(size)
    distinct, first, code, seen = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
    code = code.reshape(-1).astype(np.int32)  # a cell holds far fewer elements than that
    of_rank = seen if rank is None else rank[first]
    place = np.empty(len(distinct), np.int32)
    place[np.argsort(of_rank, kind="stable")] = np.arange(len(distinct), dtype=np.int32)  # rank, then hash
    token = place[code]
    del code, value, distinct, first
    ends = np.cumsum(size)
    sets = [token[e - s : e] for s, e in zip(size.tolist(), ends.tolist())]
    for own in sets:
        own.sort()  # in place: the sets are views of ``token``
    # Leaves of the prefix tree in order, and how far each shares its branch with the one before.
    leaves = sorted(range(n), key=lambda i: sets[i].astype(">u4").tobytes())
    spot = np.empty(n, np.int64)
    spot[leaves] = np.arange(n)
    shared = np.zeros(n, np.int64)
    for i in range(1, n):
        a, b = sets[leaves[i - 1]], sets[leaves[i]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        shared[i] = differ[0] if len(differ) else m
    # Which sets hold an element in their prefix: sets that link meet in one.
    prefix = size - least_overlap(size, num, den) + 1
    p_owner = np.repeat(np.arange(n, dtype=np.int32), prefix)
    p_token = token[ragged(ends - size, prefix)]
    by = np.argsort(p_token, kind="stable")
    p_token, p_owner = p_token[by], p_owner[by]
    forest, links = Forest(np.arange(n) if label is None else label), []
    mark = np.zeros(len(seen), bool)
    for x in np.argsort(-prefix, kind="stable").tolist():
        own = sets[x]
        heads = own[: prefix[x]]
        lo, hi = np.searchsorted(p_token, heads), np.searchsorted(p_token, heads, side="right")
        near = np.unique(p_owner[ragged(lo, hi - lo)])
        fits = (forest.label[near] != forest.label[x]) & (num * np.maximum(size[near], size[x]) <= den * np.minimum(size[near], size[x]))
        if side is not None:
            fits &= side[near] != side[x]
        near = near[fits]
        if not len(near):
            continue
        mark[own] = True
        near = near[np.argsort(spot[near])]
        counted = np.zeros(1, np.int64)  # overlap after each element of the branch walked last
        known, dead, last = 0, -1, -1
        for y in near.tolist():
            at = int(spot[y])
            common = 0 if last < 0 else int(shared[last + 1 : at + 1].min())
            last = at
            known = min(known, common)
            if 0 <= dead <= common:  # the branch was cut above this leaf
                spare_at_cut = dead - int(counted[dead])
                total = len(own) + len(sets[y])
                if spare_at_cut > len(sets[y]) - -(-num * total // (num + den)):
                    continue
            dead = -1
            if forest.label[y] == forest.label[x]:
                continue
            other = sets[y]
            need = -(-num * (len(own) + len(other)) // (num + den))  # overlap that makes a link
            spare = len(other) - need
            got = counted[: known + 1]
            while True:
                done = len(got) - 1
                missing = done - int(got[done])
                if missing > spare:
                    dead = done
                    break
                if done == len(other):
                    break
                step = other[done : done + max(spare - missing + 1, 64)]
                got = np.concatenate([got, got[done] + np.cumsum(mark[step])])
            counted, known = got, len(got) - 1
            if dead < 0:
                links.append((x, y))
                forest.join(x, y)
        mark[own] = False
    return links


def _squeeze(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _open(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of compressed texts."""
    import zstandard

    tool = zstandard.ZstdDecompressor()
    raw = [tool.decompress(p) for p in packed]
    return np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)


def _sets(packed: list[bytes], n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of compressed texts, in steps of bounded memory."""
    value, size, at = [np.zeros(0, U64)], [np.zeros(0, np.int64)], 0
    while at < len(packed):
        end, total = at, 0
        while end < len(packed) and (end == at or total < PART // 4):  # compressed to about a third
            total += len(packed[end])
            end += 1
        v, s = shingle_sets(*_open(packed[at:end]), n_words)
        value.append(v)
        size.append(s)
        at = end
    return np.concatenate(value), np.concatenate(size)


def _buckets(element: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket (of n, at most 2 ** 24) of sorted elements, and 32 bits that tell elements of one bucket apart; both ascend."""
    scaled = (element >> U64(24)) * U64(n)
    return (scaled >> U64(40)).astype(np.int64), ((scaled & U64((1 << 40) - 1)) >> U64(8)).astype(np.uint32)


def _pack(ascending: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending 32-bit numbers and how often each occurs (255 at most), compressed."""
    step = np.diff(ascending, prepend=np.uint32(0)).astype("<u4")
    return _squeeze(step.view(np.uint8).reshape(-1, 4).T.tobytes() + np.minimum(times, 255).astype(np.uint8).tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 5
    step = np.ascontiguousarray(raw[: 4 * n].reshape(4, n).T).view("<u4").reshape(-1)
    return np.cumsum(step, dtype=np.uint32), raw[4 * n :]


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Frequencies as ranks of one byte: 0 for one document, else by eighths of a doubling."""
    return np.where(counts < 2, 0, np.minimum(8 * np.log2(np.maximum(counts, 1)), 255)).astype(np.uint8)


def _chunks(source: DataFrame, n_words: int) -> DataFrame:
    """Some megabytes of documents a row: ``chunk``, ids, set sizes and digests of all of them, and the compressed texts of those
    to go on (``fresh``: their places): with words, and of equal sets in a task one."""
    schema = pa.schema([("chunk", pa.int64()), *((n, pa.list_(pa.int64())) for n in ("ids", "sizes", "hi", "lo")), ("fresh", pa.list_(pa.int32())), ("packed", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[tuple[int, int]] = set()
        number = TaskContext.get().partitionId() << 32
        held: list[list] = [[] for _ in schema.types[1:]]

        def close() -> pa.RecordBatch:
            nonlocal number
            ids, sizes, hi, lo = (np.concatenate(x) for x in held[:4])
            row = [number, ids, sizes, hi, lo, held[4][:], held[5][:]]
            for x in held:
                x.clear()
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        gathered = rows = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, off, buf, _ in parts(batch.column(1), PART):
                value, size = shingle_sets(off, buf, n_words)
                hi, lo = digests(value, size)
                fresh = [i for i, k in enumerate(zip(hi.tolist(), lo.tolist())) if size[i] and k not in seen and not seen.add(k)]
                raw = buf.tobytes()
                packed = [_squeeze(raw[off[i] : off[i + 1]]) for i in fresh]
                for x, more in zip(held[:4], (ids[a:b], size, hi, lo)):
                    x.append(more)
                held[4] += [rows + i for i in fresh]
                held[5] += packed
                rows += b - a
                gathered += len(buf)
                if gathered >= CHUNK:
                    yield close()
                    gathered = rows = 0
        if rows:
            yield close()

    arrays = ", ".join(f"{n} array<long>" for n in ("ids", "sizes", "hi", "lo"))
    return source.mapInArrow(runtime.lean(run), f"chunk long, {arrays}, fresh array<int>, packed array<binary>")


def _survivors(chunks: DataFrame, total: int, n_words: int, num: int, den: int) -> DataFrame:
    """Documents with an element of another document in their prefix: digest, ``n``, these elements (``prefix``), the compressed
    text, and the ranks of all elements in the order of their hashes (``ranks``, compressed)."""
    spark = chunks.sparkSession
    n_buckets = min(max(4 * runtime.partitions(spark), total // BUCKET), 1 << 24)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("blob", pa.binary())])
        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                element, times = np.unique(_sets(packed.as_py(), n_words)[0], return_counts=True)
                bucket, low = _buckets(element, n_buckets)
                heads = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(heads[1:], len(bucket))
                blobs = [_pack(low[a:b], times[a:b]) for a, b in zip(heads.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[heads]), pa.array(np.full(len(heads), number)), pa.array(blobs, pa.binary())], schema=out)

    def rate(t: pa.Table) -> pa.Table:
        got = [_unpack(b) for b in t.column("blob").to_pylist()]
        element, inverse = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
        rank = _ranks(np.bincount(inverse.reshape(-1), np.concatenate([g[1] for g in got]), len(element)))[inverse.reshape(-1)]
        cuts = np.cumsum([0] + [len(g[0]) for g in got])
        ranks = [_squeeze(rank[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.table([t.column("bucket"), t.column("chunk"), pa.array(ranks, pa.binary())], names=["bucket", "chunk", "ranks"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        out = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("packed", pa.binary()), ("ranks", pa.binary())])
        for batch in batches:
            for hi, lo, fresh, packed, rated in zip(*(batch.column(i).to_pylist() for i in range(5))):
                value, size = _sets(packed, n_words)
                element, inverse = np.unique(value, return_inverse=True)
                rank = np.frombuffer(b"".join(tool.decompress(r["ranks"]) for r in sorted(rated, key=lambda r: r["bucket"])), np.uint8)[inverse.reshape(-1)]
                row = np.repeat(np.arange(len(size)), size)
                often = rank > 0
                least = least_overlap(size, num, den)
                many = np.bincount(row[often], minlength=len(size))
                ends = np.cumsum(size)
                rows = []
                for i in np.flatnonzero(many >= least).tolist():
                    own = slice(ends[i] - size[i], ends[i])
                    r, v = rank[own], value[own]
                    order = np.lexsort((v, r))
                    own_prefix = v[order[size[i] - many[i] : size[i] - least[i] + 1]]
                    rows.append((hi[fresh[i]], lo[fresh[i]], int(size[i]), own_prefix.view(np.int64), packed[i], _squeeze(r.tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), out.types)], schema=out)

    counted = chunks.select("chunk", "packed").mapInArrow(runtime.lean(count), "bucket long, chunk long, blob binary")
    rated = counted.groupBy("bucket").applyInArrow(runtime.lean_group(rate), "bucket long, chunk long, ranks binary")
    back = rated.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ranks")).alias("rated"))
    joined = chunks.select("chunk", "hi", "lo", "fresh", "packed").join(back.hint("merge"), "chunk")
    return joined.select("hi", "lo", "fresh", "packed", "rated").mapInArrow(runtime.lean(choose), "hi long, lo long, n long, prefix array<long>, packed binary, ranks binary")


def _verified(pairs: DataFrame, nodes: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (node, pivot) that link."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            pivots, first, which = np.unique(b, return_index=True, return_inverse=True)
            value, size = _sets(batch.column(2).to_pylist(), n_words)
            p_value, p_size = _sets(batch.column(3).take(pa.array(first)).to_pylist(), n_words)
            ends, p_ends = np.cumsum(size), np.cumsum(p_size)
            good = np.zeros(len(a), bool)
            for i, k in enumerate(which.reshape(-1).tolist()):
                own, other = value[ends[i] - size[i] : ends[i]], p_value[p_ends[k] - p_size[k] : p_ends[k]]
                at = np.searchsorted(other, own)
                common = int((other[np.minimum(at, len(other) - 1)] == own).sum())
                good[i] = den * common >= num * (len(own) + len(other) - common)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], schema=out)

    text = nodes.select("node", "packed")
    whole = pairs.hint("merge").join(text, "node").select("pivot", F.col("node").alias("a"), F.col("packed").alias("own"))
    whole = whole.hint("merge").join(text.select(F.col("node").alias("pivot"), "packed"), "pivot")
    return whole.select("a", "pivot", "own", "packed").mapInArrow(runtime.lean(run), "a long, b long")


def _units(rest: DataFrame) -> DataFrame:
    """Which sets meet in which trees: ``rest`` (w, node, n, label, least: the least label at w) as ``unit, by_element, node, label``."""
    reached = runtime.cut(components(rest.select("label", "least")).withColumnRenamed("node", "label"), "reached")
    placed = rest.join(reached.hint("merge"), "label")
    once = placed.groupBy("root", "node").agg(F.first("n").alias("n"), F.count("*").alias("elements"))
    cost = once.groupBy("root").agg(F.sum("n").alias("whole"), F.sum(F.col("n") * F.col("elements")).alias("copied"))
    chunks = F.ceil(F.col("whole") / CELL)
    # Written, so that the join reads plain rows on both sides, and splits a common root's.
    cost = runtime.cut(cost.select("root", ((chunks > 1) & (F.col("copied") < F.col("whole") * chunks)).alias("by_element")), "cost")
    placed = placed.join(cost.hint("merge"), "root")
    return placed.select(F.when(F.col("by_element"), F.col("w")).otherwise(F.col("root")).alias("unit"), "by_element", "node", "n", "label").distinct()


def _dealt(units: DataFrame) -> DataFrame:
    """Tasks of at most about two CELLs that together compare all sets of a unit that have different labels: ``unit, by_element, kind,
    i, j, node, label, side``. A unit of one CELL is one task (kind 0). Of a larger one, the label that holds most goes in chunks that
    each meet every chunk of the rest (kind 1), never each other, and the chunks of the rest meet in pairs (kind 2). So a family that
    its pivots have linked costs work in proportion, whatever else its elements hold."""
    key = ["unit", "by_element"]
    by_label = units.groupBy(*key, "label").agg(F.sum("n").alias("held"))
    most = F.max(F.struct("held", "label"))
    sizes = by_label.groupBy(*key).agg(F.sum("held").alias("whole"), most.alias("most"))
    count = lambda n: F.greatest(F.ceil(n / CELL), F.lit(1)).cast("int")
    sizes = sizes.select(*key, F.col("most.label").alias("major"), (F.col("whole") <= CELL).alias("one"), count(F.col("most.held")).alias("majors"), count(F.col("whole") - F.col("most.held")).alias("others"))
    sizes = runtime.cut(sizes, "sizes")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    zero = F.lit(0)
    own = part("others")
    apart = F.concat(
        F.transform(upto("majors"), lambda i: task(1, i, own, F.lit(1))),
        F.transform(upto("others"), lambda j: task(2, F.least(own, j), F.greatest(own, j), own)),
    )
    tasks = F.when(F.col("one"), F.array(task(0, zero, zero, zero))).when(F.col("label") == F.col("major"), F.transform(upto("others"), lambda j: task(1, part("majors"), j, zero))).otherwise(apart)
    rows = units.join(sizes.hint("merge"), key).select(*key, "node", "label", F.explode(tasks).alias("t"))
    return rows.select(*key, "t.kind", "t.i", "t.j", "node", "label", "t.side")


def _tree_links(rest: DataFrame, nodes: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """Links between the sets of ``rest`` that its labels do not connect."""
    units = runtime.cut(_units(rest), "units")

    def cell(t: pa.Table) -> pa.Table:
        import zstandard

        tool = zstandard.ZstdDecompressor()
        value, size = _sets(t.column("packed").to_pylist(), n_words)
        rank = np.frombuffer(b"".join(tool.decompress(r) for r in t.column("ranks").to_pylist()), np.uint8)
        node, side = t.column("node").to_numpy(), t.column("side").to_numpy()
        kind, i, j = (t.column(c)[0].as_py() for c in ("kind", "i", "j"))
        across = kind == 1 or i != j
        label = np.unique(t.column("label").to_numpy(), return_inverse=True)[1].reshape(-1)
        a, b = np.array(tree_join(value, size, num, den, rank, side if across else None, label), np.int64).reshape(-1, 2).T
        return pa.table([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    at_work = _dealt(units).hint("merge").join(nodes.select("node", "packed", "ranks"), "node")
    return at_work.groupBy("unit", "by_element", "kind", "i", "j").applyInArrow(runtime.lean_group(cell), "a long, b long")


def _rest(held: DataFrame, known: DataFrame) -> DataFrame:
    """Of ``held`` (w, node, n) the elements whose documents the components ``known`` do not connect: ``w, node, n, label, least``."""
    labelled = held.select("w", "node", "n").join(known.hint("merge"), "node", "left").select("w", "node", "n", F.coalesce("root", "node").alias("label"))
    labelled = runtime.cut(labelled, "labelled")
    apart = runtime.cut(labelled.groupBy("w").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("w", "least"), "apart")
    rest = runtime.cut(labelled.join(apart.hint("merge"), "w"), "rest")
    runtime.drop(labelled, apart)
    return rest


def _grouped(docs: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """Per row of ``docs`` with an id: ``doc_id, n_shingles, hi, lo, component_id``."""
    spark = docs.sparkSession
    runtime.tune(spark)
    # Merge joins at every size: a plan that changes with the size would hide what a join costs on a large input.
    chunks = runtime.cut(_chunks(runtime.texts(docs), n_words), "chunks")
    flat = F.explode(F.arrays_zip("ids", "sizes", "hi", "lo")).alias("d")
    signed = chunks.select(flat).select(F.col("d.ids").alias("doc_id"), F.col("d.sizes").alias("n_shingles"), "d.hi", "d.lo")
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    classes = signed.filter("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"))
    classes = runtime.cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers hold once written
    found = runtime.cut(_survivors(chunks, total, n_words, num, den).withColumn("at", F.monotonically_increasing_id()), "survivors", free=True)
    once = found.groupBy("hi", "lo").agg(F.min("at").alias("at")).join(classes.hint("merge"), ["hi", "lo"]).select("at", "node")
    nodes = runtime.cut(found.join(once.hint("merge"), "at").select("node", "n", "prefix", "packed", "ranks"), "nodes")
    runtime.drop(found)
    posted = nodes.select(F.explode("prefix").alias("w"), "node", "n")
    often = runtime.cut(posted.groupBy("w").agg(F.min(F.struct("node", "n")).alias("pivot"), F.count("*").alias("held")).filter("held > 1").select("w", "pivot"), "often")
    met = posted.join(often.hint("merge"), "w")
    near = (F.col("node") != F.col("pivot.node")) & (num * F.greatest("n", "pivot.n") <= den * F.least("n", "pivot.n"))
    pairs = met.filter(near).select("node", F.col("pivot.node").alias("pivot")).distinct()
    links = runtime.cut(_verified(pairs, nodes, n_words, num, den), "links")
    known = runtime.cut(components(links), "known")
    rest = _rest(met, known)
    for turn in range(TURNS):  # more pivots, each drawn anew, for elements that many documents share
        drawn = F.min_by(F.struct("node", "n", "label"), F.xxhash64("node", F.lit(turn)))
        crowds = runtime.cut(rest.groupBy("w").agg(drawn.alias("pivot"), F.count("*").alias("held")).filter(F.col("held") > CROWD).select("w", "pivot"), "crowds")
        if crowds.isEmpty():
            break
        near = (F.col("label") != F.col("pivot.label")) & (num * F.greatest("n", "pivot.n") <= den * F.least("n", "pivot.n"))
        pairs = rest.join(crowds.hint("merge"), "w").filter(near).select("node", F.col("pivot.node").alias("pivot")).distinct()
        links = links.unionByName(runtime.cut(_verified(pairs, nodes, n_words, num, den), "links"))
        known = runtime.cut(components(links), "known")
        rest = _rest(rest, known)
    if not rest.isEmpty():
        more = runtime.cut(_tree_links(rest, nodes, n_words, num, den), "links", free=True)
        known = runtime.cut(components(links.unionByName(more)), "known")
    reps = runtime.cut(known.join(classes.hint("merge"), "node").select("node", "root", "rep"), "reps")
    least = runtime.cut(reps.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    least = reps.join(least.hint("merge"), "root").select("node", "component_id")
    home = classes.join(least.hint("merge"), "node", "left").select("hi", "lo", F.coalesce("component_id", "rep").alias("component_id"))
    home = runtime.cut(home, "home")
    runtime.drop(nodes, often, rest, known, classes)
    some = signed.filter("n_shingles > 0").join(home.hint("merge"), ["hi", "lo"]).select("doc_id", "n_shingles", "hi", "lo", "component_id")
    return some.unionByName(signed.filter("n_shingles = 0").select("doc_id", "n_shingles", "hi", "lo", F.col("doc_id").alias("component_id")))


def groups(docs: DataFrame, n_words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``, the least ``doc_id`` that links reach.

    Texts without words (null ones too) have no shingles and link with nothing. Repeated rows
    have equal sets, so they fall into one component. An empty table gives no rows. Rows without
    an id are left out.
    """
    return _grouped(docs, n_words, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, n_words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of alike texts, that of the least ``doc_id``; texts without words and rows without an id all stay.

    Of rows that repeat an id, one whose text is of the group's kept class stays (the least text)."""
    grouped = _grouped(docs, n_words, num, den)
    kept = runtime.cut(grouped.filter("doc_id = component_id").select("doc_id").distinct(), "kept")
    times = runtime.cut(grouped.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1"), "repeated")
    if times.isEmpty():
        out = docs.join(kept.hint("merge"), "doc_id", "left_semi")
    else:
        out = _of_repeated(docs, grouped, times, n_words).unionByName(docs.join(times.hint("merge"), "doc_id", "left_anti").join(kept.hint("merge"), "doc_id", "left_semi").select(*docs.columns))
    return out.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def _of_repeated(docs: DataFrame, grouped: DataFrame, times: DataFrame, n_words: int) -> DataFrame:
    """The rows to keep among those whose id occurs more than once: of each set class whose component is the id, one row; texts without words all."""
    own = "_" * (1 + max(map(len, docs.columns)))  # begins names that the table does not have
    hi_lo = [f"{own}hi", f"{own}lo"]
    rows = docs.join(times.select("doc_id").hint("merge"), "doc_id", "left_semi")
    keys = grouped.filter("doc_id = component_id").select("doc_id", "n_shingles", F.col("hi").alias(hi_lo[0]), F.col("lo").alias(hi_lo[1]))
    keys = keys.join(times.select("doc_id").hint("merge"), "doc_id", "left_semi").filter("n_shingles > 0").groupBy("doc_id").agg(F.collect_set(F.struct(*hi_lo)).alias(f"{own}keys"))
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digests(v, s) + (s,) for v, s in (shingle_sets(off, buf, n_words) for _, _, off, buf, _ in parts(batch.column(at)))]
            hi, lo, size = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hi), pa.array(lo), pa.array(size.astype(np.int64))], names=[*batch.schema.names, *hi_lo, f"{own}n"])

    marked = rows.mapInArrow(runtime.lean(run), StructType([*rows.schema.fields, *(StructField(n, LongType()) for n in (*hi_lo, f"{own}n"))]))
    same = marked.join(keys.hint("merge"), "doc_id").filter(F.array_contains(f"{own}keys", F.struct(*hi_lo)))
    least = same.withColumn(f"{own}turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter(F.col(f"{own}turn") == 1)
    return least.select(*docs.columns).unionByName(marked.filter(F.col(f"{own}n") == 0).select(*docs.columns))

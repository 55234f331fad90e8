"""Hybrid retrieval: metadata filters and exact cosine distance, nearest first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparklog.functions import vectors
from sparklog.functions.clock import parse_bound
from sparklog.operators.embed import Embedder, HashingEmbedder
from sparklog.sources.tables import Store


def filtered(segments: DataFrame, *, from_utc: str | datetime | None = None, to_utc: str | datetime | None = None, source_id: str | None = None, severity: str | None = None, log_type: str | None = None, time: str = "event_time_utc") -> DataFrame:
    """Only the filters that are given become predicates, so they reach the scan; both time bounds are inclusive."""
    for name, value in (("source_id", source_id), ("severity", severity), ("log_type", log_type)):
        if value is not None:
            segments = segments.filter(F.col(name) == value)
    lo, hi = parse_bound(from_utc), parse_bound(to_utc)
    if lo is not None:
        segments = segments.filter(F.col(time) >= F.lit(lo))
    if hi is not None:
        segments = segments.filter(F.col(time) <= F.lit(hi))
    return segments


def rank_occurrences(rows: DataFrame, query: Sequence[float], top_k: int, tiebreak: Sequence[str], vector: str = "embedding") -> DataFrame:
    """The k rows nearest to the query with their ``distance``."""
    return rows.withColumn("distance", vectors.cosine_distance(F.col(vector), vectors.literal(query))).drop(vector).orderBy("distance", *tiebreak).limit(top_k)


def rank_distinct(rows: DataFrame, query: Sequence[float], top_k: int, key: str, time: str, vector: str = "embedding") -> DataFrame:
    """The k keys nearest to the query: least distance, occurrences, first and last time."""
    near = rows.withColumn("distance", vectors.cosine_distance(F.col(vector), vectors.literal(query)))
    found = near.groupBy(key).agg(F.min("distance").alias("distance"), F.count("*").alias("occurrences"), F.min(time).alias("first_seen_utc"), F.max(time).alias("last_seen_utc"))
    return found.orderBy("distance", key).limit(top_k)


def retrieve(store: Store, query_text: str, *, top_k: int = 10, distinct: bool = True, embedder: Embedder | None = None, **filters) -> DataFrame:
    """Segments nearest to a text among those with a vector of this model and version.

    distinct: one row per signature text over all sources; else one per occurrence. Filters as in ``filtered``."""
    embedder = embedder or HashingEmbedder()
    query = embedder.encode([query_text])[0].tolist()
    stored = store.read("gold_embeddings", filters.get("source_id"))
    stored = stored.filter((F.col("embedding_model") == embedder.model) & (F.col("embedding_version") == embedder.version)).select("segment_id", "embedding")
    segments = filtered(store.read("gold_exception_segments"), **filters)
    rows = segments.join(stored, F.col("id") == F.col("segment_id"))
    if distinct:
        return rank_distinct(rows, query, top_k, "segment_text", "event_time_utc").select("segment_text", "distance", "occurrences", "first_seen_utc", "last_seen_utc")
    return rank_occurrences(rows, query, top_k, ["segment_text", "id"]).select("segment_text", "distance", "silver_entry_id", "source_id", "severity", "logger", "event_time_utc")


#: Bytes of query vectors that one pass over the rows holds in every task.
BLOCK_BYTES = 32 << 20
#: Distances this close may change places when Spark computes them.
TIE = 1e-9


def batch_retrieve(queries: DataFrame, rows: DataFrame, top_k: int, query_id: str, row_id: str, vector: str = "embedding") -> DataFrame:
    """The k rows nearest to each query of a stated set: ``query_id, row_id, distance, rank``; no distance (a zero vector) comes first, as in ``retrieve``.

    The queries are cut into blocks of bounded bytes. For each, tasks read their rows once, keep the k nearest of every query
    with all rows that tie with the last of them, and only those are shuffled. Distances are computed as everywhere, in Spark."""
    spark = queries.sparkSession
    kind = dict(queries.dtypes)[query_id], dict(rows.dtypes)[row_id]
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("query"))
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("query")).alias("dim")).first()
    if not size.n or not size.dim:
        return spark.createDataFrame([], f"query_id {kind[0]}, row_id {kind[1]}, distance double, rank int")
    blocks = -(-size.n * size.dim * 8 // BLOCK_BYTES)
    out = None
    for i in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).collect() if blocks > 1 else asked.collect()
        part = _nearest_in(rows, [r.query_id for r in block], [r.query for r in block], top_k, row_id, vector, kind)
        out = part if out is None else out.unionByName(part)
    exact = out.select("query_id", "row_id", vectors.cosine_distance(F.col("own"), F.col("query")).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return exact.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)


def _nearest_in(rows: DataFrame, ids: list, query: list, top_k: int, row_id: str, vector: str, kind: tuple[str, str]) -> DataFrame:
    """Per task and query, the rows that may be among the k nearest, with both vectors."""
    held = rows.sparkSession.sparkContext.broadcast((ids, np.array([q if q is not None else [] for q in query], float)))
    schema = f"query_id {kind[0]}, row_id {kind[1]}, own array<double>, query array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = held.value
        unit_q = _unit(q)
        best: list[list[tuple[float, object, np.ndarray]]] = [[] for _ in names]
        last = np.full(len(names), np.inf)
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            distance = 1 - _unit(v) @ unit_q.T
            distance = np.where(np.isnan(distance), -np.inf, distance)
            own = batch.column(0).to_pylist()
            for j in range(len(names)):
                near = np.flatnonzero(distance[:, j] <= last[j] + TIE)
                if not len(near):
                    continue
                best[j] += [(distance[i, j], own[i], v[i]) for i in near]
                if len(best[j]) > 4 * top_k:
                    least = sorted(x[0] for x in best[j])[top_k - 1]
                    best[j] = [x for x in best[j] if x[0] <= least + TIE]
                    last[j] = least
        flat = [(n, x[1], x[2], q[j]) for j, n in enumerate(names) for x in best[j]]
        for at in range(0, len(flat), 1000):
            some = flat[at : at + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], to_arrow_type(kinds[0])), pa.array([x[1] for x in some], to_arrow_type(kinds[1])), pa.array([x[2].tolist() for x in some], pa.list_(pa.float64())), pa.array([x[3].tolist() for x in some], pa.list_(pa.float64()))], names=["query_id", "row_id", "own", "query"])

    kinds = [f.dataType for f in rows.select(F.lit(None).cast(kind[0]).alias("a"), F.lit(None).cast(kind[1]).alias("b")).schema.fields]
    return rows.select(row_id, F.col(vector).cast("array<double>").alias("own")).mapInArrow(run, schema)


def _unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row has none and becomes NaN."""
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 0, length, np.nan)


def approximate(rows: DataFrame, query: Sequence[float], top_k: int, row_id: str, vector: str = "embedding", width: float = 0.8, tables: int = 6) -> DataFrame:
    """Approximate nearest rows by bucketed random projection of unit vectors; ``distance`` is the cosine distance."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = rows.select(row_id, array_to_vector(vectors.normalized(F.col(vector))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=1).fit(unit)
    length = sum(x * x for x in query) ** 0.5 or 1.0
    found = model.approxNearestNeighbors(unit, Vectors.dense([x / length for x in query]), top_k, distCol="euclid")
    return found.select(row_id, (F.col("euclid") * F.col("euclid") / 2).alias("distance"))


def similarity(distance: Column) -> Column:
    return 1 - distance

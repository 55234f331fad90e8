"""Deterministic pattern analytics on events: counts in time, bursts, co-occurrence, correlation, clusters, quality."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket of distinct times.
BUCKET = 3600


def bucket_counts(events: DataFrame, time: str, width: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events per tumbling window of ``width`` (and keys): ``bucket`` (its start), keys, ``n``."""
    return events.filter(F.col(time).isNotNull()).groupBy(F.window(time, width).alias("_w"), *keys).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("bucket"), *keys, "n")


def bursts(events: DataFrame, time: str, gap_seconds: int, least: int, keys: Sequence[str] = ()) -> DataFrame:
    """Runs of events no more than ``gap_seconds`` apart with ``least`` events or more: keys, ``burst_start``, ``burst_end``, ``n``.

    Events of one time count as one place in the run. Times are cut into buckets of BUCKET seconds, and what a bucket must know of
    the earlier ones (their last time, how many runs began) is carried over, so no window holds more than a bucket or one row per bucket."""
    at = events.filter(F.col(time).isNotNull()).groupBy(*keys, time).agg(F.count("*").alias("_n"))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    at = at.withColumn("_s", seconds(F.col(time))).withColumn("_b", F.floor(F.col("_s") / BUCKET))
    own, along = Window.partitionBy(*keys, "_b").orderBy("_s"), Window.partitionBy(*keys).orderBy("_b")
    same = lambda a, b: reduce(and_, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in [*keys, "_b"]))

    def carried(rows: DataFrame, edges: DataFrame, *names: str) -> DataFrame:
        """Rows with columns of their bucket's edge."""
        return rows.alias("r").join(edges.alias("e"), same("r", "e")).select("r.*", *(f"e.{n}" for n in names))

    lasts = at.groupBy(*keys, "_b").agg(F.max("_s").alias("_last"))
    lasts = lasts.select(*keys, "_b", F.lag("_last").over(along).alias("_before"))
    at = carried(at, lasts, "_before")
    fresh = F.coalesce(F.col("_s") - F.coalesce(F.lag("_s").over(own), "_before") > gap_seconds, F.lit(True))
    at = at.withColumn("_fresh", fresh.cast("long"))
    begun = at.groupBy(*keys, "_b").agg(F.sum("_fresh").alias("_runs"))
    begun = begun.select(*keys, "_b", F.coalesce(F.sum("_runs").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    runs = carried(at, begun, "_earlier").withColumn("_run", F.col("_earlier") + F.sum("_fresh").over(own))
    return runs.groupBy(*keys, "_run").agg(F.min(time).alias("burst_start"), F.max(time).alias("burst_end"), F.sum("_n").alias("n")).filter(F.col("n") >= least).drop("_run")


def cooccurrence(events: DataFrame, time: str, width: str, what: str) -> DataFrame:
    """Pairs of kinds seen in one time bucket: ``first_kind``, ``second_kind`` (in order), ``buckets`` they share.

    The distinct kinds of a bucket are paired, not its events."""
    kinds = events.filter(F.col(time).isNotNull() & F.col(what).isNotNull()).select(F.window(time, width).alias("_w"), F.col(what).alias("_k")).distinct()
    other = kinds.select("_w", F.col("_k").alias("_o"))
    pairs = kinds.join(other, "_w").filter("_k < _o")
    return pairs.groupBy(F.col("_k").alias("first_kind"), F.col("_o").alias("second_kind")).agg(F.count("*").alias("buckets"))


def correlate(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of rows no more than ``seconds`` apart: an equi-join on time buckets of that width and a residual test.

    Column names of the two sides must differ. Each right row goes to its bucket and both neighbours."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000 or 1
    a = left.filter(F.col(left_time).isNotNull()).withColumn("_b", F.floor(micros(left_time) / width))
    b = right.filter(F.col(right_time).isNotNull()).withColumn("_b", F.explode(F.array(*(F.floor(micros(right_time) / width) + i for i in (-1, 0, 1)))))
    return a.join(b, "_b").filter(F.abs(micros(left_time) - micros(right_time)) <= seconds * 1_000_000).drop("_b")


def cluster(rows: DataFrame, k: int, row_id: str, vector: str = "embedding", seed: int = 1) -> DataFrame:
    """k-means over unit vectors: ``row_id``, ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from sparklog.functions.vectors import normalized

    unit = rows.select(row_id, array_to_vector(normalized(F.col(vector))).alias("features"))
    unit = unit.persist(StorageLevel.MEMORY_AND_DISK)  # read by every iteration
    try:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(unit)
    finally:
        unit.unpersist()
    return model.transform(unit).select(row_id, "cluster")


def rate(condition: Column) -> Column:
    return F.count(F.when(condition, 1)) / F.count("*")


def parse_failures(entries: DataFrame, source: str = "source_id", parsed: str = "parsed") -> DataFrame:
    return entries.groupBy(source).agg(F.count("*").alias("entries"), F.count(F.when(~F.col(parsed), 1)).alias("failed"), rate(~F.col(parsed)).alias("failure_rate"))


def silent_sources(events: DataFrame, source: str, time: str, now: Column, quiet_hours: float) -> DataFrame:
    """Sources whose last event is more than ``quiet_hours`` before ``now``: ``last_seen``."""
    last = events.groupBy(source).agg(F.max(time).alias("last_seen"))
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 3.6e9
    return last.filter(hours > quiet_hours)


def coverage(rows: DataFrame, covered: DataFrame, key: str, by: str) -> DataFrame:
    """Share of rows per ``by`` whose key is in ``covered``."""
    mine = covered.select(F.col(key)).distinct().withColumn("_has", F.lit(True))
    return rows.join(mine, key, "left").groupBy(by).agg(F.count("*").alias("rows"), F.count("_has").alias("covered"), (F.count("_has") / F.count("*")).alias("coverage"))


def freshness(entries: DataFrame, event_time: str, ingested: str, within_seconds: int) -> DataFrame:
    """One row: share of entries queryable within the time, and the 95th percentile of the lag in seconds."""
    lag = (F.unix_micros(F.col(ingested).cast("timestamp")) - F.unix_micros(F.col(event_time).cast("timestamp"))) / 1e6
    return entries.agg(rate(lag <= within_seconds).alias("share_in_time"), F.percentile_approx(lag, 0.95, 100000).alias("p95_seconds"))


def success(runs: DataFrame, status: str = "status") -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), rate(F.col(status) == "completed").alias("success_rate"))

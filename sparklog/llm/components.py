"""Connected components by alternating stars, on DataFrames only.

Each round hangs every neighbour on the least node it has met (large star), then every
node on its least neighbour (small star). Rounds are written to the shared folder, so
lineage stays short; nothing goes to the driver but a count and a checksum per round.
A hub's edges meet only in joins, which Spark splits when they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm import runtime


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
    return r[0], r[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges`` (two long columns; order and repeats do not matter), root the least node reachable."""
    a, b = edges.columns
    stars = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    stars = runtime.cut(stars, "edges")
    before = _state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join reads plain rows on both sides, and splits a hub's.
        least = runtime.cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        large = runtime.cut(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = runtime.cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u")
        earlier, stars = stars, runtime.cut(small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "edges")
        runtime.drop(earlier, least, large, lower)
        now = _state(stars)
        if now == before:
            break
        before = now
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))

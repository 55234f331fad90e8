"""Parquet tables under one root, appended to and never updated in place.

Changed rows are appended as new versions and the latest is read; rows that must be
unique are anti-joined with what is stored before they are appended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.schemas import PARTITIONED, TABLES


class Store:
    """Tables of ``schemas.TABLES`` under ``root`` (any path Spark can write)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        if table not in TABLES:
            raise KeyError(f"unknown table {table!r}; known: {', '.join(sorted(TABLES))}")
        return f"{self.root}/{table}"

    def _fs(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made.getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def exists(self, table: str) -> bool:
        fs, path = self._fs(self.path(table))
        return fs.exists(path)

    def create_all(self) -> list[str]:
        """Make every missing table, empty. Returns those made."""
        made = [t for t in TABLES if not self.exists(t)]
        for t in made:
            self._fs(self.path(t))[0].mkdirs(self._fs(self.path(t))[1])
        return made

    def read(self, table: str, source_id: str | None = None) -> DataFrame:
        if self.exists(table):
            # The schema is given, so an empty folder reads as an empty table and nothing is inferred.
            df = self.spark.read.schema(TABLES[table]).parquet(self.path(table))
        else:
            df = self.spark.createDataFrame([], TABLES[table])
        return df if source_id is None else df.filter(F.col("source_id") == source_id)

    def append(self, table: str, df: DataFrame) -> int:
        """Append rows. Returns how many, counted as they are written."""
        written = Observation()
        rows = df.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[table].fields)).observe(written, F.count(F.lit(1)).alias("n"))
        writer = rows.write.mode("append")
        (writer.partitionBy("source_id") if table in PARTITIONED else writer).parquet(self.path(table))
        return written.get.get("n", 0)

    def append_new(self, table: str, df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), source_id: str | None = None) -> int:
        """Append the rows whose key is not stored yet, the first by ``order`` of each key. Returns how many."""
        known = self.read(table, source_id).select(*keys)
        fresh = first_of(df, keys, order).join(known, list(keys), "left_anti")
        return self.append(table, fresh)

    def latest(self, table: str, keys: Sequence[str]) -> DataFrame:
        return latest_by(self.read(table), keys, "version")

    def overwrite_source(self, table: str, source_id: str, df: DataFrame | None = None) -> None:
        """Replace what a source has in a partitioned table (by nothing, if ``df`` is None)."""
        if table not in PARTITIONED:
            raise ValueError(f"{table} is not laid out by source")
        self._place(table, source_id, None if df is None else self._draft(table, source_id, df))

    def _draft(self, table: str, source_id: str, df: DataFrame) -> str:
        """Rows written beside a table: never read and overwrite one path in one plan."""
        draft = f"{self.root}/_draft_{table}_{source_id}"
        df.select(*(F.col(f.name).cast(f.dataType) for f in TABLES[table].fields if f.name != "source_id")).write.mode("overwrite").parquet(draft)
        return draft

    def _place(self, table: str, source_id: str, draft: str | None) -> None:
        fs, path = self._fs(f"{self.path(table)}/source_id={source_id}")
        fs.delete(path, True)
        if draft is not None:
            fs.mkdirs(path.getParent())
            fs.rename(self._fs(draft)[1], path)

    def delete_segments(self, segment_ids: DataFrame, source_id: str) -> None:
        """Delete segments (``id``) with their vectors."""
        gone = segment_ids.select("id")
        vectors = self.read("gold_embeddings", source_id).join(gone.withColumnRenamed("id", "segment_id"), "segment_id", "left_anti")
        kept = self.read("gold_exception_segments", source_id).join(gone, "id", "left_anti")
        # Both are written before either is put in place: the ids may be read from these tables.
        drafts = [(t, self._draft(t, source_id, rows)) for t, rows in (("gold_embeddings", vectors), ("gold_exception_segments", kept))]
        for table, draft in drafts:
            self._place(table, source_id, draft)

    def delete_cascade(self, processed_log_ids: DataFrame, source_id: str) -> None:
        """Delete files' control rows by key with the entries that hang on them."""
        gone = processed_log_ids.select(F.col("id").alias("processed_log_id"))
        kept = self.read("bronze_landing", source_id).join(gone, "processed_log_id", "left_anti")
        self.overwrite_source("bronze_landing", source_id, kept)
        control = self.read("bronze_processed_logs").join(processed_log_ids.select("id"), "id", "left_anti")
        draft = f"{self.root}/_draft_control"
        control.write.mode("overwrite").parquet(draft)
        fs, path = self._fs(self.path("bronze_processed_logs"))
        fs.delete(path, True)
        fs.rename(self._fs(draft)[1], path)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the least by ``order`` (and then by all columns), so a rerun keeps the same one."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*((F.col(c) if c in keys else F.col(f"_row.{c}")).alias(c) for c in df.columns))


def latest_by(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row of greatest ``version`` of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")

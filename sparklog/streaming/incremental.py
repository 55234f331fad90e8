"""Bronze as a stream of files, and windowed counts with late data (extensions)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparklog.operators.bronze import IngestResult, ingest_files
from sparklog.session import pin_utc
from sparklog.sources.config import SourceConfig
from sparklog.sources.tables import Store


def stream_to_bronze(store: Store, config: SourceConfig, checkpoint: str) -> StreamingQuery:
    """New files of a source as they appear, each micro-batch landed as a batch run would; stops when none is left.

    The checkpoint remembers files, hashes and the table's keys make a repeated batch harmless."""
    spark = pin_utc(store.spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(config.location)

    def land(batch: DataFrame, _: int) -> None:
        name = F.element_at(F.split("path", "/"), -1)
        rows = batch.select(name.alias("file_name"), F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), r"^file:(?://)?", "").alias("file_path"), F.col("modificationTime").alias("modified"), "length", "content")
        ingest_files(store, config, rows.filter(F.lower("file_name").startswith(config.file_prefix.lower())), IngestResult(config.source_id, uuid.uuid4().hex))

    return files.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts per tumbling window; events later than ``late`` behind the newest are left out (on streams)."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("bucket"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Bursts on streams: session windows that close after ``gap``."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("burst_start"), *keys, "n")


def run_once(spark: SparkSession, frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream holds now, through an in-memory sink (tests)."""
    query = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)

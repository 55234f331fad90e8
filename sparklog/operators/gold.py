"""Gold: exceptions to signature segments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.operators.bronze import hash_id
from sparklog.operators.parsers import get_parser
from sparklog.session import pin_utc
from sparklog.sources.config import SourceConfig
from sparklog.sources.tables import Store


@dataclass
class SegmentResult:
    source_id: str
    exceptions_processed: int = 0
    segments_written: int = 0

    def __str__(self) -> str:
        return f"Gold run of source {self.source_id!r}: {self.exceptions_processed} exceptions, {self.segments_written} segments"


def segment_exceptions(exceptions: DataFrame, log_type: str) -> DataFrame:
    """Rows with ``exception_text`` to one row per segment: the other columns, ``segment_index``, ``segment_type``, ``segment_text``."""
    pieces = get_parser(log_type).segments(F.col("exception_text"))
    rows = exceptions.select(*(c for c in exceptions.columns if c != "exception_text"), F.posexplode(pieces).alias("segment_index", "segment_text"))
    return rows.withColumn("segment_type", F.when(F.col("segment_index") == 0, "signature").otherwise("inner_signature"))


def unsegmented(store: Store, source_id: str) -> DataFrame:
    done = store.read("gold_segmented", source_id).select(F.col("silver_entry_id").alias("id"))
    return store.read("silver_log_entries", source_id).filter(F.col("is_exception") & F.col("exception_text").isNotNull()).join(done, "id", "left_anti")


def transform_to_gold(store: Store, config: SourceConfig) -> SegmentResult:
    pin_utc(store.spark)
    waiting = unsegmented(store, config.source_id).select(F.col("id").alias("silver_entry_id"), "source_id", "log_type", "exception_text", "event_time_utc", "severity", "logger")
    result = SegmentResult(config.source_id, waiting.count())
    if result.exceptions_processed:
        taken = waiting.select("silver_entry_id", "source_id")
        rows = segment_exceptions(waiting, config.log_type).withColumn("id", hash_id("silver_entry_id", F.col("segment_index").cast("string"))).withColumn("created_at_utc", F.current_timestamp())
        result.segments_written = store.append_new("gold_exception_segments", rows, ["silver_entry_id", "segment_index"], (), config.source_id)
        store.append("gold_segmented", taken)
    return result

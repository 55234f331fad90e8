"""Schemas of the stored tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, B, TS, NTZ, D = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.TimestampNTZType(), T.DoubleType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], True) for f in fields])


STATUSES = ("in_progress", "completed", "failed")
SEVERITIES = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "UNKNOWN")

#: Versions of a file's control row: the latest ``version`` of a key holds.
BRONZE_PROCESSED_LOGS = _schema(
    ("id", S), ("source_id", S), ("log_type", S), ("file_name", S), ("file_path", S), ("file_hash", S), ("status", S),
    ("reprocess_count", I), ("first_seen_utc", TS), ("updated_at_utc", TS), ("completed_utc", TS), ("version", T.LongType()),
)
BRONZE_LANDING = _schema(
    ("id", S), ("processed_log_id", S), ("entry_hash", S), ("raw_entry", S), ("header_excerpt", S), ("landed_at_utc", TS), ("source_id", S),
)
BRONZE_ARCHIVE = T.StructType([*BRONZE_LANDING.fields[:-1], T.StructField("archived_at_utc", TS), BRONZE_LANDING.fields[-1]])
BRONZE_RUNS = _schema(
    ("id", S), ("source_id", S), ("location", S), ("run_host", S), ("status", S), ("files_seen", I), ("files_processed", I),
    ("files_skipped_unchanged", I), ("files_failed", I), ("entries_landed", I), ("entries_skipped_duplicate", I), ("preamble_lines", I),
    ("started_utc", TS), ("finished_utc", TS), ("duration_seconds", D), ("version", T.LongType()),
)
#: Entries that silver has taken, stored or not (repeats are taken but not stored).
SILVER_DIGESTED = _schema(("landing_id", S), ("source_id", S))
SILVER_LOG_ENTRIES = _schema(
    ("id", S), ("entry_hash", S), ("bronze_landing_id", S), ("log_type", S), ("parser_version", S), ("ingested_at_utc", TS),
    ("event_time_utc", TS), ("event_time_local", NTZ), ("source_timezone", S), ("severity", S), ("severity_raw", S), ("message", S),
    ("logger", S), ("is_exception", B), ("exception_text", S), ("extra_fields", S), ("source_id", S),
)
#: Exceptions that gold has taken, whether or not they gave a segment.
GOLD_SEGMENTED = _schema(("silver_entry_id", S), ("source_id", S))
GOLD_EXCEPTION_SEGMENTS = _schema(
    ("id", S), ("silver_entry_id", S), ("log_type", S), ("segment_index", I), ("segment_type", S), ("segment_text", S),
    ("event_time_utc", TS), ("severity", S), ("logger", S), ("created_at_utc", TS), ("source_id", S),
)
GOLD_EMBEDDINGS = _schema(
    ("id", S), ("segment_id", S), ("embedding_model", S), ("embedding_version", S), ("embedding", T.ArrayType(T.FloatType())),
    ("created_at_utc", TS), ("source_id", S),
)
PIPELINE_ERRORS = _schema(("at_utc", TS), ("source_id", S), ("step", S), ("error", S), ("detail", S))
PIPELINE_STEPS = _schema(("run_id", S), ("at_utc", TS), ("source_id", S), ("place", I), ("step", S), ("state", S), ("seconds", D), ("note", S))

TABLES: dict[str, T.StructType] = {
    "bronze_processed_logs": BRONZE_PROCESSED_LOGS,
    "bronze_landing": BRONZE_LANDING,
    "bronze_archive": BRONZE_ARCHIVE,
    "bronze_runs": BRONZE_RUNS,
    "silver_digested": SILVER_DIGESTED,
    "silver_log_entries": SILVER_LOG_ENTRIES,
    "gold_segmented": GOLD_SEGMENTED,
    "gold_exception_segments": GOLD_EXCEPTION_SEGMENTS,
    "gold_embeddings": GOLD_EMBEDDINGS,
    "pipeline_errors": PIPELINE_ERRORS,
    "pipeline_steps": PIPELINE_STEPS,
}
#: Large tables lie in one folder per source, so a source's runs prune the rest.
PARTITIONED = {"bronze_landing", "bronze_archive", "silver_digested", "silver_log_entries", "gold_segmented", "gold_exception_segments", "gold_embeddings"}

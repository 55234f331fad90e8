"""Bronze: files to entries, incrementally.

A file whose bytes have not changed is skipped; of a changed file only entries that were
not landed before are added. All of it is a join of the listing with the control table
and one append; the driver sees counts only.
"""

from __future__ import annotations

import socket
import time
import uuid
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparklog.functions import text
from sparklog.operators.parsers import get_parser
from sparklog.session import pin_utc
from sparklog.sources.config import ConfigError, SourceConfig
from sparklog.sources import logfiles
from sparklog.sources.logfiles import discover_files, fingerprints, large_entries, read_texts
from sparklog.sources.tables import Store, first_of

FILE_KEY = ["source_id", "file_name", "file_path"]


def hash_id(*parts) -> F.Column:
    """A row's id from its natural key, the same on every run."""
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


@dataclass
class IngestResult:
    source_id: str
    run_id: str = ""
    files_seen: int = 0
    files_processed: int = 0
    files_skipped_unchanged: int = 0
    files_failed: int = 0
    entries_landed: int = 0
    entries_skipped_duplicate: int = 0
    preamble_lines: int = 0
    duration_seconds: float | None = None

    def __str__(self) -> str:
        took = "n/a" if self.duration_seconds is None else f"{self.duration_seconds:.2f}"
        rows = [("files seen", self.files_seen), ("files processed", self.files_processed), ("files unchanged", self.files_skipped_unchanged), ("files failed", self.files_failed), ("entries landed", self.entries_landed), ("entries duplicate", self.entries_skipped_duplicate), ("lines before a header", self.preamble_lines), ("duration (s)", took)]
        return f"Bronze run {self.run_id} of source {self.source_id!r}:\n" + "\n".join(f"  {k:<22}: {v}" for k, v in rows)


def check_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern, if Java's engine compiles it."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(text.FLAGS + text.anchored(pattern))
    except Exception as e:
        raise ConfigError(f"header_pattern does not compile: {pattern!r}") from e
    return pattern


def entries_of(files: DataFrame, header_pattern: str) -> DataFrame:
    """Rows with ``text`` to one row per entry: the other columns, ``position``, ``raw_entry``, ``header_excerpt``, ``entry_hash``."""
    rows = files.select(*(c for c in files.columns if c != "text"), F.posexplode(text.split_entries(F.col("text"), header_pattern)).alias("position", "raw_entry"))
    return described(rows)


def has_history(store: Store, source_id: str) -> bool:
    return not store.read("bronze_processed_logs").filter(F.col("source_id") == source_id).limit(1).isEmpty()


def save_run(store: Store, result: IngestResult, config: SourceConfig, status: str, started: datetime, version: int) -> None:
    now = datetime.now(timezone.utc) if status != "in_progress" else None
    row = {k: v for k, v in asdict(result).items() if k not in ("run_id",)} | {"id": result.run_id, "location": config.location, "run_host": socket.gethostname(), "status": status, "started_utc": started, "finished_utc": now, "version": version}
    from sparklog.schemas import BRONZE_RUNS

    store.append("bronze_runs", store.spark.createDataFrame([tuple(row[f.name] for f in BRONZE_RUNS.fields)], BRONZE_RUNS))


def described(entries: DataFrame) -> DataFrame:
    head = text.strip(F.substring_index("raw_entry", "\n", 1))
    return entries.withColumn("header_excerpt", head).withColumn("entry_hash", F.sha2("raw_entry", 256))


def _large(store: Store, config: SourceConfig, files: list[tuple[str, str]], header: str) -> tuple[DataFrame, int]:
    """Entries of large files, and how many lines stand before their first headers."""
    rows = large_entries(store.spark, [f"{path}/{name}" for name, path in files], header).withColumn("source_id", F.lit(config.source_id))
    rows = rows.withColumn("file_name", F.element_at(F.split("path", "/"), -1)).withColumn("file_path", F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), r"^file:(?://)?", ""))
    before = rows.filter("raw_entry is null").agg(F.sum("lines")).first()[0] or 0
    entries = rows.filter("raw_entry is not null").withColumn("processed_log_id", hash_id(*FILE_KEY)).withColumn("position", F.lit(0))
    return described(entries.select("source_id", "processed_log_id", "position", "raw_entry")), before


def ingest_files(store: Store, config: SourceConfig, files: DataFrame, result: IngestResult) -> IngestResult:
    """Land what is new in ``files`` (as ``discover_files`` gives them) and update the control table."""
    spark = store.spark
    parser = get_parser(config.log_type)
    header = check_pattern(spark, config.header_pattern or parser.header_pattern)
    listed = files.select("file_name", "file_path").withColumn("source_id", F.lit(config.source_id))
    known = store.latest("bronze_processed_logs", FILE_KEY).select(*FILE_KEY, F.col("file_hash").alias("old_hash"), F.col("status").alias("old_status"), F.col("reprocess_count").alias("old_count"), F.col("first_seen_utc").alias("old_seen"), F.col("version").alias("old_version"))
    # Hashes first: texts are read again only of the files that changed.
    hashed = fingerprints(files).withColumn("source_id", F.lit(config.source_id))
    state = listed.join(hashed, FILE_KEY, "left").join(known, FILE_KEY, "left")
    failed = F.col("file_hash").isNull()
    same = F.col("file_hash").eqNullSafe(F.col("old_hash")) & (F.col("old_status") != "failed")
    outcome = F.when(failed, "failed").when(same, "unchanged").otherwise("changed")
    # One row per file: small beside the logs themselves, and needed three times.
    state = state.withColumn("outcome", outcome).persist()
    try:
        counts = {r["outcome"]: r["count"] for r in state.groupBy("outcome").count().collect()}
        result.files_seen = sum(counts.values())
        result.files_failed, result.files_skipped_unchanged, result.files_processed = (counts.get(k, 0) for k in ("failed", "unchanged", "changed"))
        if result.files_processed:
            changed = state.filter("outcome = 'changed'").select("file_name", "file_path")
            small = files.filter(F.col("length") <= logfiles.LARGE).join(changed, ["file_name", "file_path"], "left_semi")
            texts = read_texts(small).withColumn("source_id", F.lit(config.source_id))
            texts = texts.withColumn("processed_log_id", hash_id(*FILE_KEY))
            # Texts are split once: lines before a header and entries are counted on the way.
            seen, split = Observation(), Observation()
            texts = texts.observe(seen, F.sum(text.preamble_lines(F.col("text"), header)).alias("n"))
            found = entries_of(texts.select("source_id", "processed_log_id", "text"), header)
            large = [(r.file_name, r.file_path) for r in state.filter((F.col("outcome") == "changed") & (F.col("length") > logfiles.LARGE)).select("file_name", "file_path").collect()]
            if large:
                parts, before = _large(store, config, large, header)
                found = found.select("source_id", "processed_log_id", "position", "raw_entry", "header_excerpt", "entry_hash").unionByName(parts)
                result.preamble_lines = before
            found = found.observe(split, F.count(F.lit(1)).alias("n"))
            rows = found.withColumn("id", hash_id("processed_log_id", "entry_hash")).withColumn("landed_at_utc", F.current_timestamp())
            result.entries_landed = store.append_new("bronze_landing", rows, ["processed_log_id", "entry_hash"], ["position"], config.source_id)
            result.entries_skipped_duplicate = (split.get.get("n") or 0) - result.entries_landed
            result.preamble_lines += seen.get.get("n") or 0
        now = F.current_timestamp()
        control = state.filter("outcome <> 'unchanged'").select(
            hash_id(*FILE_KEY).alias("id"), *FILE_KEY, F.lit(config.log_type).alias("log_type"), "file_hash",
            F.when(F.col("outcome") == "failed", "failed").otherwise("in_progress").alias("status"),
            F.when(F.col("old_version").isNull(), 0).otherwise(F.col("old_count") + 1).alias("reprocess_count"),
            F.coalesce("old_seen", now).alias("first_seen_utc"), now.alias("updated_at_utc"), F.lit(None).cast("timestamp").alias("completed_utc"),
            (F.coalesce("old_version", F.lit(0)) + 1).alias("version"),
        )
        store.append("bronze_processed_logs", control)
    finally:
        state.unpersist()
    return result


def ingest_to_bronze(store: Store, config: SourceConfig) -> IngestResult:
    """One incremental run of a source; its run row ends as completed or failed, with the counters reached."""
    pin_utc(store.spark)
    if not config.location:
        raise ConfigError(f"source {config.source_id!r} has no location")
    result = IngestResult(config.source_id, uuid.uuid4().hex)
    started, clock = datetime.now(timezone.utc), time.monotonic()
    save_run(store, result, config, "in_progress", started, 1)
    status = "failed"
    try:
        bounded = config.cutoff == "always" or not has_history(store, config.source_id)
        files = discover_files(store.spark, config.location, config.file_prefix, config.earliest_date if bounded else None)
        ingest_files(store, config, files, result)
        status = "completed"
    finally:
        result.duration_seconds = time.monotonic() - clock
        save_run(store, result, config, status, started, 2)
    return result


def undigested(store: Store, source_id: str) -> DataFrame:
    """Landed entries that silver has not taken."""
    done = store.read("silver_digested", source_id).select(F.col("landing_id").alias("id"))
    return store.read("bronze_landing", source_id).join(done, "id", "left_anti")


def files_with_undigested(store: Store, source_id: str) -> DataFrame:
    """Latest control rows of the files that have such entries."""
    waiting = undigested(store, source_id).select(F.col("processed_log_id").alias("id"))
    return store.latest("bronze_processed_logs", FILE_KEY).filter(F.col("source_id") == source_id).join(waiting, "id", "left_semi")


def mark_completed(store: Store, source_id: str) -> None:
    """New control versions for files in progress whose entries are all digested."""
    waiting = undigested(store, source_id).select(F.col("processed_log_id").alias("id"))
    open_files = store.latest("bronze_processed_logs", FILE_KEY).filter((F.col("source_id") == source_id) & (F.col("status") == "in_progress"))
    now = F.current_timestamp()
    done = open_files.join(waiting, "id", "left_anti").withColumn("status", F.lit("completed")).withColumn("completed_utc", now).withColumn("updated_at_utc", now).withColumn("version", F.col("version") + 1)
    if not done.isEmpty():
        store.append("bronze_processed_logs", done)


def archive(store: Store, source_id: str) -> int:
    """Copy digested entries to the archive, then keep only undigested ones in landing. Returns how many were moved."""
    waiting = undigested(store, source_id)
    moved = store.read("bronze_landing", source_id).join(waiting.select("id"), "id", "left_anti").withColumn("archived_at_utc", F.current_timestamp())
    n = store.append_new("bronze_archive", moved, ["processed_log_id", "entry_hash"], (), source_id)
    store.overwrite_source("bronze_landing", source_id, waiting)
    return n


__all__ = ["IngestResult", "archive", "entries_of", "files_with_undigested", "first_of", "ingest_files", "ingest_to_bronze", "mark_completed", "undigested"]

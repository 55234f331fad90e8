"""Silver: entries to parsed events of one shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparklog.functions.clock import check_zone
from sparklog.functions.privacy import Policy
from sparklog.operators.bronze import hash_id, mark_completed, undigested
from sparklog.operators.parsers import get_parser
from sparklog.session import pin_utc
from sparklog.sources.config import SourceConfig
from sparklog.sources.tables import Store


@dataclass
class TransformResult:
    source_id: str
    entries_read: int = 0
    entries_written: int = 0
    entries_skipped_duplicate: int = 0
    entries_unparsed: int = 0

    def __str__(self) -> str:
        return f"Silver run of source {self.source_id!r}: {self.entries_read} read, {self.entries_written} written, {self.entries_skipped_duplicate} duplicate, {self.entries_unparsed} without a known header"


def parse_entries(entries: DataFrame, config: SourceConfig, policy: Policy | None = None) -> DataFrame:
    """Rows with ``raw_entry`` plus the parsed columns, by the source's parser and privacy policy."""
    pin_utc(entries.sparkSession)
    return get_parser(config.log_type).parse(entries, config, policy or Policy(config.pii_policy))


def transform_to_silver(store: Store, config: SourceConfig) -> TransformResult:
    """Parse every entry not taken yet. The policy, its key and the zone are checked before anything is read."""
    parser, policy = get_parser(config.log_type), Policy(config.pii_policy)
    check_zone(config.timezone)
    waiting = undigested(store, config.source_id)
    rows = parse_entries(waiting, config, policy)
    key = ["entry_hash"] if config.dedup == "entry_hash" else ["bronze_landing_id"]
    natural = ["source_id", "entry_hash"] if config.dedup == "entry_hash" else ["source_id", "bronze_landing_id"]
    rows = rows.withColumnRenamed("id", "bronze_landing_id").withColumn("id", hash_id(*natural)).withColumn("log_type", F.lit(config.log_type))
    rows = rows.withColumn("parser_version", F.lit(parser.version)).withColumn("source_timezone", F.lit(config.timezone)).withColumn("ingested_at_utc", F.current_timestamp())
    # Entries are parsed once: they are counted as they are written.
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("parsed"), 1)).alias("odd"))
    result = TransformResult(config.source_id)
    if not waiting.isEmpty():
        taken = waiting.select(F.col("id").alias("landing_id"), "source_id")
        columns = [f.name for f in store.read("silver_log_entries").schema.fields]
        result.entries_written = store.append_new("silver_log_entries", rows.select(*columns), key, ["bronze_landing_id"], config.source_id)
        result.entries_read, result.entries_unparsed = seen.get.get("n", 0), seen.get.get("odd", 0)
        store.append("silver_digested", taken)  # after silver: a run that dies before it is repeated without harm
    result.entries_skipped_duplicate = result.entries_read - result.entries_written
    mark_completed(store, config.source_id)
    return result


def reset_silver(store: Store, source_id: str) -> None:
    """Forget what silver made of a source, so the next run parses all again. Ids stay the same, so gold stays attached."""
    store.overwrite_source("silver_log_entries", source_id)
    store.overwrite_source("silver_digested", source_id)

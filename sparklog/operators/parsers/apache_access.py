"""Apache access logs in combined format, one line per entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions import clock, text
from sparklog.functions.privacy import Policy
from sparklog.operators.parsers.registry import register
from sparklog.sources.config import SourceConfig

# The log's grammar and names.
LINE = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)(?: "([^"]*)" "([^"]*)")?'
TIME, WALL = "d/MMM/yyyy:HH:mm:ss Z", "d/MMM/yyyy:HH:mm:ss"
LOGGER = "apache.access"
KEPT = 500


def severity_of(status: Column) -> Column:
    return F.when(status >= 500, "ERROR").when(status >= 400, "WARN").otherwise("INFO")


@register
class ApacheAccess:
    log_type = "apache_access"
    version = "apache_access/1.0"
    header_pattern = r"^\S+ \S+ \S+ \["

    def parse(self, entries: DataFrame, config: SourceConfig, policy: Policy) -> DataFrame:
        out = entries.withColumn("_line", text.strip(F.coalesce("raw_entry", F.lit(""))))
        out = out.withColumn("parsed", text.matches(F.col("_line"), LINE))
        group = lambda i: F.when(F.col("parsed"), text.extract(F.col("_line"), LINE, i))
        out = out.withColumn("_words", F.split(text.strip(group(4)), r"(?U)\s+")).withColumn("_status", group(5).cast("int"))
        n = F.when(text.strip(group(4)) == "", 0).otherwise(F.size("_words"))
        word = lambda i: F.element_at("_words", i)
        out = out.withColumn("_method", F.when(n.between(1, 3), word(1)).otherwise("")).withColumn("_protocol", F.when(n == 3, word(3)).otherwise(""))
        out = out.withColumn("_path", F.when(n.isin(2, 3), word(2)).when(n == 1, "").otherwise(group(4)))
        at = F.try_to_timestamp(group(3), F.lit(TIME))
        out = out.withColumn("event_time_utc", at)
        # The wall clock as written; without a valid offset the whole time is void.
        out = out.withColumn("event_time_local", F.when(at.isNotNull(), clock.first_format(F.substring_index(group(3), " ", 1), WALL)))
        out = out.withColumn("severity", F.when(F.col("parsed"), severity_of(F.col("_status"))).otherwise("UNKNOWN")).withColumn("severity_raw", F.col("_status").cast("string"))
        out = out.withColumn("logger", F.lit(LOGGER))
        said = text.strip(F.concat("_method", F.lit(" "), "_path", F.lit(" -> "), "severity_raw"))
        out = out.withColumn("message", F.when(F.col("parsed"), said).otherwise(F.substring("_line", 1, KEPT)))
        out = out.withColumn("is_exception", F.coalesce(F.col("_status") >= 500, F.lit(False)))
        failed = text.strip(F.concat(F.lit("HTTP "), "severity_raw", F.lit(" "), "_method", F.lit(" "), "_path"))
        out = out.withColumn("exception_text", F.when(F.col("is_exception"), failed))
        tail = text.matches(F.col("_line"), LINE.removesuffix("?"))
        values = {
            "client_ip": group(1), "remote_user": group(2), "method": F.col("_method"), "path": F.col("_path"), "protocol": F.col("_protocol"),
            "status": F.col("_status"), "bytes": F.when(group(6) != "-", group(6)), "referer": F.when(tail, group(7)), "user_agent": F.when(tail, group(8)),
        }
        known = F.to_json(F.struct(*(policy.field(k, v).alias(k) for k, v in values.items())), {"ignoreNullFields": "false"})
        unknown = F.to_json(F.struct(policy.field("unparsed", F.col("_line")).alias("unparsed")), {"ignoreNullFields": "false"})
        out = out.withColumn("extra_fields", F.when(F.col("parsed"), known).otherwise(unknown))
        return out.drop("_line", "_words", "_status", "_method", "_protocol", "_path")

    def segments(self, exception_text: Column) -> Column:
        whole = text.strip(exception_text)
        return F.filter(F.array(whole), lambda s: s.isNotNull() & (s != ""))

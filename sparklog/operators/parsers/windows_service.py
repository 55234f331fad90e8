"""Windows service logs: a header line, indented ``key : value`` lines, an exception block.

The body is read line by line inside expressions that are each evaluated once, so an entry
is parsed where it lies and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions import clock, text
from sparklog.functions.privacy import Policy
from sparklog.operators.parsers.registry import register
from sparklog.sources.config import SourceConfig

# The log's grammar and vocabulary.
HEADER = r"^(\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} (?:AM|PM))\s+(\w+):\s*(.*)$"
KEY_VALUE = r"^\s{2,}([^:]+?)\s*:\s*(.*)$"
NAMESPACE = r"^([A-Za-z_][\w.]*\.[\w.]+)"
SIGNATURE = r"^([A-Za-z_][\w.]*(?:Exception|Error))\s*:\s*(.*)$"
INNER_MARKER = "--->"
SEVERITY = {"Critical": "FATAL", "Error": "ERROR", "Warning": "WARN", "Information": "INFO", "Verbose": "DEBUG", "Debug": "DEBUG"}
EXCEPTION_KEYS = ["Exception", "Exception Type", "Stack Trace"]
TRAILING_KEYS = [
    "user", "country", "account id", "duration", "status", "time taken", "worker type", "queue name", "queue depth", "affected count",
    "unique data sources", "deleted count", "modified count", "new count", "detail", "warning",
]
TIME_FORMATS = ("M/d/yyyy h:mm:ss a", "d/M/yyyy h:mm:ss a")

RUNS = "struct<inside: boolean, since: int, runs: array<struct<first: int, end: int>>>"


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, however often they are used: Catalyst does not merge projections across a generator."""
    made = F.struct(*(c.alias(n) for n, c in columns.items()))
    return rows.select("*", F.inline(F.array(made)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once; unlike ``once``, nothing is evaluated if the result is not asked for."""
    return F.get(F.transform(F.array(value), use), 0)


def severity_of(level: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(F.element_at(known, level), F.lit("UNKNOWN"))


def classified(line: Column, ends: list[str]) -> Column:
    """A body line with its key and value (null key: not a pair) and whether it opens or closes an exception block."""
    # KEY_VALUE without a regex: two white spaces or more, a key of one character or more, the first colon.
    colon = F.instr(line, ":")
    before = F.substring(line, F.lit(1), colon - 1)
    pair = (colon > 3) & (F.length(before) - F.length(text.lstrip(before)) >= 2)
    key = F.when(pair, text.strip(before))
    value = F.when(pair, text.strip(F.substring(line, colon + 1, F.length(line))))
    opens, closes = F.coalesce(key.isin(EXCEPTION_KEYS), F.lit(False)), F.coalesce(F.lower(key).isin(TRAILING_KEYS) | key.isin(ends), F.lit(False))
    return F.struct(key.alias("key"), value.alias("value"), opens.alias("opens"), closes.alias("closes"), line.alias("line"))


def exception_runs(rows: Column) -> Column:
    """Places (first, end) of the runs of classified lines that belong to an exception block, in one pass over the lines."""

    def step(acc: Column, x: Column) -> Column:
        state = lambda inside, since, runs: F.struct(inside.alias("inside"), since.alias("since"), runs.alias("runs")).cast(RUNS)
        closed = F.concat(acc["runs"], F.array(F.struct(acc["since"].alias("first"), x["at"].alias("end"))))
        return F.when(acc["inside"] & x["closes"], state(F.lit(False), F.lit(0), closed)).when(~acc["inside"] & x["opens"], state(F.lit(True), x["at"], acc["runs"])).otherwise(acc)

    start = F.expr(f"cast(named_struct('inside', false, 'since', 0, 'runs', array()) as {RUNS})")
    ended = lambda acc: F.when(acc["inside"], F.concat(acc["runs"], F.array(F.struct(acc["since"].alias("first"), F.size(rows).alias("end"))))).otherwise(acc["runs"])
    marked = F.transform(rows, lambda x, i: F.struct(x["opens"].alias("opens"), x["closes"].alias("closes"), i.alias("at")))
    return F.aggregate(marked, start, step, ended)


def pairs_of(rows: Column) -> Column:
    """Key and value of each pair among classified lines: lines without a key go on from the pair before them, and the last pair of a key holds."""
    keyed = F.filter(F.transform(rows, lambda x, i: F.when(x["key"].isNotNull(), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(keyed, 2, F.size(rows)), F.array(F.size(rows)))

    def pair(place: Column) -> Column:
        first, end = place["first"], place["end"]
        more = F.transform(F.slice(rows, first + 2, end - first - 1), lambda x: text.strip(x["line"]))
        head = F.get(rows, first)
        return F.struct(head["key"].alias("key"), F.array_join(F.concat(F.array(head["value"]), more), "\n").alias("value"))

    found = F.transform(F.arrays_zip(keyed.alias("first"), ends.alias("end")), pair)
    keys = F.transform(found, lambda p: p["key"])
    return F.filter(found, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(rows)), p["key"]))


def may_hold_exception(raw: Column) -> Column:
    """False only for entries without an exception block: none of the keys that open one is in the text."""
    return F.exists(F.array(*map(F.lit, EXCEPTION_KEYS)), lambda k: raw.contains(k))


@register
class WindowsService:
    log_type = "windows_service"
    version = "windows_service/1.0"
    header_pattern = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} (AM|PM)"

    def parse(self, entries: DataFrame, config: SourceConfig, policy: Policy) -> DataFrame:
        rows = text.lines(text.newlines(F.coalesce("raw_entry", F.lit(""))))
        out = entries.withColumn("_lines", rows).withColumn("_head", text.strip(F.element_at("_lines", 1)))
        out = out.withColumn("parsed", text.matches(F.col("_head"), HEADER))
        group = lambda i: F.when(F.col("parsed"), text.extract(F.col("_head"), HEADER, i))
        out = out.withColumn("severity_raw", group(2)).withColumn("_rest", text.strip(F.coalesce(group(3), F.col("_head"))))
        named = F.col("parsed") & text.matches(F.col("_rest"), NAMESPACE)
        out = out.withColumn("logger", F.when(named, text.extract(F.col("_rest"), NAMESPACE, 1)))
        after = text.strip(F.when(named, F.expr("substring(_rest, length(logger) + 1)")).otherwise(F.col("_rest")))
        out = out.withColumn("message", text.blank_to_null(after))
        out = out.withColumn("severity", F.when(F.col("parsed"), severity_of(F.col("severity_raw"))).otherwise("UNKNOWN"))
        out = out.withColumn("event_time_local", clock.first_format(group(1), *TIME_FORMATS))
        out = out.withColumn("event_time_utc", clock.local_to_utc(F.col("event_time_local"), config.timezone))
        # Fields named in the policy end an exception block too: they must not hide in its text.
        rows = F.transform(F.slice("_lines", 2, 1_000_000_000), lambda s: classified(s, sorted(policy.actions)))
        out = once(once(out, _rows=rows), _runs=F.when(may_hold_exception(F.col("raw_entry")), exception_runs(F.col("_rows"))).otherwise(F.array().cast("array<struct<first: int, end: int>>")))
        block = F.flatten(F.transform("_runs", lambda r: F.transform(F.slice("_rows", r["first"] + 1, r["end"] - r["first"]), lambda x: text.rstrip(x["line"]))))
        rest = F.filter("_rows", lambda x, i: ~F.exists("_runs", lambda r: (r["first"] <= i) & (i < r["end"])))
        out = out.withColumn("is_exception", F.size("_runs") > 0)
        out = out.withColumn("exception_text", F.when(F.col("is_exception"), text.strip(F.array_join(block, "\n"))))
        body = F.when(F.col("is_exception"), rest).otherwise(F.col("_rows"))
        fields = bound(body, lambda lines: F.map_from_entries(pairs_of(lines)))
        if policy.actions:  # uses the fields more than once
            out = once(out, _fields=fields)
            fields = policy.fields(F.col("_fields"))
        return out.withColumn("extra_fields", F.to_json(fields, {"ignoreNullFields": "false"})).drop("_lines", "_head", "_rest", "_rows", "_runs", "_fields")

    def segments(self, exception_text: Column) -> Column:
        pieces = F.flatten(F.transform(text.lines(text.newlines(exception_text)), lambda s: F.split(s, INNER_MARKER)))
        signed = F.filter(F.transform(pieces, text.strip), lambda p: text.matches(p, SIGNATURE))
        named = F.transform(signed, lambda p: text.strip(F.concat(text.extract(p, SIGNATURE, 1), F.lit(": "), text.extract(p, SIGNATURE, 2))))
        return F.array_distinct(named)

"""Log text made by Spark: renderings of an events table, and seeded generators of whole corpora."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Exception families: type, message, inner type, inner message (no inner: empty).
FAMILIES = [
    ("Acme.Data.SqlException", "Deadlock victim", "", ""),
    ("Acme.Data.TimeoutException", "The pool is exhausted", "Acme.Net.SocketException", "Connection refused"),
    ("System.NullReferenceException", "Object reference not set", "", ""),
    ("Acme.Http.RequestError", "Upstream gave no answer", "Acme.Net.SocketException", "Host unreachable"),
]
# Of generated corpora, more families: messages that vary from one occurrence to the next (# is a number).
VARIED = [
    ("Acme.Store.UpdateException", ("Row # of the stock table was changed meanwhile", "Key # is already taken"), "Acme.Data.SqlException", "Duplicate key"),
    ("System.OperationCanceledException", ("Job # was cancelled", "The shutdown cancelled # jobs"), "", ""),
    ("System.IO.IOException", ("The file part-#.tmp is in use", "No space is left for # bytes"), "", ""),
    ("System.InvalidOperationException", ("The queue holds no element #", "Worker # has not been started"), "Acme.Queue.StateException", "Not ready"),
]
STATUSES = [200, 200, 200, 301, 404, 500, 502, 503]
LEVELS = {"error": "Error", "purchase": "Warning", "view": "Debug"}


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def props_key(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def windows_from_events(events: DataFrame, varied: bool = False) -> DataFrame:
    """Each event as a Windows service entry: ``raw_entry`` beside the event's columns and ``k``. varied: of all families, with messages that vary."""
    families = [(a, (b, b), c, d) for a, b, c, d in FAMILIES] + (VARIED if varied else [])
    e = events.withColumn("k", props_key()).withColumn("_f", F.col("k") % len(families))
    level = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), F.col("event_type")), F.lit("Information"))
    head = F.concat(F.date_format("ts", "M/d/yyyy hh:mm:ss a"), F.lit(" "), level, F.lit(": Acme.Shop.Unit"), (F.col("user_id") % 7).cast("string"), F.lit(".Worker handled "), "event_type")
    kind, inner, why = (_pick([f[i] for f in families], F.col("_f")) for i in (0, 2, 3))
    one, other = (_pick([f[1][i] for f in families], F.col("_f")) for i in (0, 1))
    number = (F.pmod(F.xxhash64("k", "user_id"), F.lit(9000)) + 1000).cast("string")
    said = F.replace(F.when(F.col("user_id") % 2 == 0, one).otherwise(other), F.lit("#"), number)
    trace = F.concat(kind, F.lit(": "), said, F.when(inner != "", F.concat(F.lit(" ---> "), inner, F.lit(": "), why)).otherwise(""))
    block = F.concat_ws("\n", F.concat(F.lit("   Exception Type : "), kind), F.concat(F.lit("   Message    : "), said), F.lit("   Stack Trace :"), trace, F.lit("   at Acme.Shop.Worker.Run() in Worker.cs:line 42"), F.lit("   Status : Failed"))
    body = F.concat_ws("\n", head, F.concat(F.lit("   User : user_"), F.col("user_id").cast("string")), F.concat(F.lit("   Amount : "), F.format_string("%.2f", "value")), F.concat(F.lit("   Key : "), F.col("k").cast("string")), F.when(F.col("event_type") == "error", block))
    return e.withColumn("raw_entry", body).drop("_f")


def apache_from_events(events: DataFrame) -> DataFrame:
    """Each event as an access-log line with offset +1000."""
    e = events.withColumn("k", props_key())
    status = _pick(STATUSES, F.col("k") % len(STATUSES))
    line = F.concat(
        F.lit("10.0."), F.floor(F.col("user_id") / 256).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"), F.lit(" - - ["),
        F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +1000] "GET /api/'), "event_type", F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" "), F.when(F.col("k") % 3 == 0, "-").otherwise(F.col("k").cast("string")), F.lit(' "-" "probe/1.0"'),
    )
    return e.withColumn("raw_entry", line)


def _draw(seed: int, *salt) -> Column:
    """A number in [0, 1) fixed by the row's columns and the seed."""
    return F.pmod(F.xxhash64(*salt, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)


def _corpus(spark: SparkSession, start: date, end: date, per_day: int, burst: int, seed: int) -> DataFrame:
    """Event slots: ``day, n, ts, u0..u3`` (draws) and ``incident``; two days in five have a burst within one hour."""
    days = (end - start).days + 1
    rows = spark.range(days * (per_day + burst)).select((F.col("id") / (per_day + burst)).cast("int").alias("d"), (F.col("id") % (per_day + burst)).alias("n"))
    rows = rows.withColumn("day", F.date_add(F.lit(start), F.col("d"))).withColumn("incident", F.col("n") >= per_day)
    rows = rows.filter(~F.col("incident") | (_draw(seed, F.lit("burst"), "d") < 0.4))
    hour = F.floor(_draw(seed, F.lit("hour"), "d") * 9) + 9
    second = F.when(F.col("incident"), hour * 3600 + F.floor(_draw(seed, F.lit("s"), "d", "n") * 480)).otherwise(F.floor(_draw(seed, F.lit("t"), "d", "n") * 86400))
    rows = rows.withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + second))
    return rows.select("day", "n", "ts", "incident", *(_draw(seed, F.lit(f"u{i}"), "d", "n").alias(f"u{i}") for i in range(4)))


def windows_corpus(spark: SparkSession, start: date, end: date, per_day: int = 500, burst: int = 40, seed: int = 42, pii: bool = True) -> DataFrame:
    """Windows service log files: ``file_name, text``. The same arguments give the same files."""
    slots = _corpus(spark, start, end, per_day, burst, seed)
    level = F.when(F.col("incident") | (F.col("u0") < 0.22), "Error").when(F.col("u0") < 0.37, "Warning").when(F.col("u0") < 0.45, "Debug").otherwise("Information")
    kind = F.when(level == "Error", "error").otherwise("task")
    e = slots.select("day", "ts", "n", level.alias("level"), kind.alias("event_type"), F.floor(F.col("u1") * 40).alias("user_id"), F.round(F.col("u2") * 900, 2).alias("value"), F.format_string('{"k": %d}', F.floor(F.col("u3") * 64).cast("long")).alias("props"))
    text = windows_from_events(e, varied=True)
    entry = F.regexp_replace("raw_entry", r"^(\S+ \S+ \S+) \w+:", F.concat(F.lit("$1 "), F.col("level"), F.lit(":")))
    entry = F.concat(entry, F.when((F.col("event_type") == "error") & F.lit(pii) & (F.col("n") % 2 == 0), F.lit("\n   Country : AU\n   Account Id : ACC-1")).otherwise(""))
    name = F.concat(F.lit("log-"), F.date_format("day", "MM-dd-yyyy"), F.lit(".log"))
    return text.select(name.alias("file_name"), "ts", "n", entry.alias("entry")).groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("ts", "n", "entry"))).alias("e")).select("file_name", F.concat(F.array_join(F.transform("e", lambda x: x["entry"]), "\n"), F.lit("\n")).alias("text"))


def apache_corpus(spark: SparkSession, start: date, end: date, per_day: int = 120, burst: int = 60, seed: int = 42) -> DataFrame:
    """Access log files: ``file_name, text``; a burst is of 5xx on few paths."""
    slots = _corpus(spark, start, end, per_day, burst, seed)
    status = F.when(F.col("incident"), _pick([500, 502, 503, 504], F.floor(F.col("u0") * 4))).otherwise(_pick([200, 200, 200, 200, 200, 200, 200, 301, 304, 404], F.floor(F.col("u0") * 10)))
    path = F.when(F.col("incident"), _pick(["/api/orders", "/api/cart"], F.floor(F.col("u1") * 2))).otherwise(_pick(["/", "/products", "/about", "/api/orders", "/api/cart", "/login"], F.floor(F.col("u1") * 6)))
    user = F.when(path.startswith("/api/") & (F.col("u2") < 0.3), _pick(["alice", "bob", "carol"], F.floor(F.col("u3") * 3))).otherwise("-")
    line = F.concat(F.lit("10."), F.floor(F.col("u2") * 200).cast("string"), F.lit(".0."), F.floor(F.col("u3") * 250).cast("string"), F.lit(" - "), user, F.lit(" ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +1000] "GET '), path, F.lit(' HTTP/1.1" '), status.cast("string"), F.lit(" "), F.when(status >= 400, F.lit(0)).otherwise(F.floor(F.col("u2") * 8000)).cast("string"), F.lit(' "-" "probe/1.0"'))
    name = F.concat(F.lit("access-"), F.date_format("day", "yyyy-MM-dd"), F.lit(".log"))
    return slots.select(name.alias("file_name"), "ts", "n", line.alias("entry")).groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("ts", "n", "entry"))).alias("e")).select("file_name", F.concat(F.array_join(F.transform("e", lambda x: x["entry"]), "\n"), F.lit("\n")).alias("text"))


def write_files(files: DataFrame, folder: str) -> int:
    """Write each ``file_name, text`` under ``folder`` (a path or URI that all executors reach). Returns how many."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/{name}") as f:
                    f.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return sum(r.n for r in files.select("file_name", "text").mapInArrow(write, "n long").collect())

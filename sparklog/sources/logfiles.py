"""Log files of a directory as rows."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.functions.text import anchored, decode_utf8, lines, matches, newlines

#: Files of more bytes are not taken as one row: they are read in splits, by line.
LARGE = 256 << 20


def discover_files(spark: SparkSession, location: str, file_prefix: str = "log", earliest: date | None = None) -> DataFrame:
    """Regular files directly in ``location`` whose name begins with the prefix (any case): ``file_name, file_path, modified, length, content``.

    Lazy: a plan that does not use ``content`` lists files and reads none. A file that cannot be read gives no row there."""
    found = spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "false").load(location.rstrip("/"))
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select(name.alias("file_name"), F.regexp_replace(F.regexp_replace("path", r"/[^/]*$", ""), r"^file:(?://)?", "").alias("file_path"), F.col("modificationTime").alias("modified"), "length", "content")
    rows = rows.filter(F.lower("file_name").startswith(file_prefix.lower()))
    if earliest is None:
        return rows
    # From the day's first moment in the zone of the machine that runs the import; the scan takes the bound.
    return rows.filter(F.col("modified") >= F.lit(datetime.combine(earliest, time.min).astimezone()))


def read_texts(files: DataFrame) -> DataFrame:
    """Adds ``file_hash`` (SHA-256 of the bytes) and ``text`` (UTF-8 with replacement, newlines only)."""
    return files.withColumn("file_hash", F.sha2("content", 256)).withColumn("text", newlines(decode_utf8(F.col("content")))).drop("content")


def fingerprints(files: DataFrame) -> DataFrame:
    """``file_name, file_path, length, file_hash``: the SHA-256 of a file's bytes; of a large file, that of its size and time, for no row could hold it."""
    columns = ["file_name", "file_path", "length"]
    small = files.filter(F.col("length") <= LARGE).select(*columns, F.sha2("content", 256).alias("file_hash"))
    stamp = F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modified").cast("string"))
    return small.unionByName(files.filter(F.col("length") > LARGE).select(*columns, F.sha2(stamp, 256).alias("file_hash")))


def large_entries(spark: SparkSession, paths: list[str], header_pattern: str) -> DataFrame:
    """Entries of large files as ``path, raw_entry`` (null: the lines before the first header, as ``lines`` many), read split by split.

    Lines are numbered in their split and grouped by the header above them. Lines before a split's first header belong to the
    last header of an earlier split, which only needs one row a split to be found. No group holds more than an entry."""
    rows = spark.read.text(paths).select("value", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_block_start").alias("split"))
    rows = rows.withColumn("at", F.monotonically_increasing_id())  # ascends within a split
    # Other line ends than newlines make more lines of one.
    rows = rows.select("path", "split", "at", F.posexplode(lines(newlines(F.make_valid_utf8(F.regexp_replace("value", r"\r$", ""))))).alias("part", "line"))
    begins = matches(F.col("line"), anchored(header_pattern))
    above = F.sum(begins.cast("long")).over(Window.partitionBy("path", "split").orderBy("at", "part"))
    rows = rows.withColumn("entry", above)
    splits = rows.groupBy("path", "split").agg(F.max("entry").alias("last"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("last") > 0, F.struct(F.col("split").alias("home"), F.col("last").alias("open"))), ignorenulls=True).over(earlier)
    splits = splits.select("path", "split", opened.alias("carried"))
    rows = rows.join(splits, ["path", "split"])
    home = F.when(F.col("entry") > 0, F.struct(F.col("split").alias("home"), F.col("entry").alias("open"))).otherwise(F.col("carried"))
    grouped = rows.withColumn("home", home)
    whole = grouped.filter("home is not null").groupBy("path", "home").agg(F.array_sort(F.collect_list(F.struct("split", "at", "part", "line"))).alias("l"))
    before = grouped.filter("home is null").groupBy("path").agg(F.count("*").alias("lines"))
    entries = whole.select("path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("raw_entry"), F.lit(None).cast("long").alias("lines"))
    return entries.unionByName(before.select("path", F.lit(None).cast("string").alias("raw_entry"), "lines"))

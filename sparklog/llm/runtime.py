"""What the operators share on the driver: session settings and cutting lineage.

Lineage is cut by writing Parquet into the folder named by ``spark.checkpoint.dir``,
which every executor can read, so a lost executor costs a retry and nothing else.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog.session import new_dir, spread


def cut(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    free: let Spark delete the shuffle files of the plan just written now (it does so when the
    driver collects its garbage), where a step's shuffles are as large as its input."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    if free:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    made = spark.read.schema(df.schema).parquet(path)
    made._cut_path = path
    if _NOTED:
        _NOTED[-1].append(path)
    return made


#: Lists of the folders written since each ``temporary`` that is open.
_NOTED: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """Folders that ``cut`` writes meanwhile are deleted at the end, but for those taken off the list that this gives."""
    noted: list[str] = []
    _NOTED.append(noted)
    try:
        yield noted
    finally:
        _NOTED.remove(noted)
        _delete(spark, noted)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        made = spark._jvm.org.apache.hadoop.fs.Path(path)
        made.getFileSystem(spark._jsc.hadoopConfiguration()).delete(made, True)


def drop(*tables: DataFrame) -> None:
    """Delete the folders of tables made by ``cut`` that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, [t._cut_path])


def tune(spark: SparkSession) -> None:
    """Arrow batches small enough for rows of long texts. Plans read these settings when they run, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def tidy() -> None:
    """Give memory that is free back to the machine: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with suppress(OSError, AttributeError):  # another C library has nothing to trim
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(work: Callable) -> Callable:
    """A function of batches that tidies up when it is done."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(given)
        finally:
            tidy()

    return batches


def lean_group(work: Callable) -> Callable:
    """The same for a function of a group's table."""

    def group(given: pa.Table) -> pa.Table:
        try:
            return work(given)
        finally:
            tidy()

    return group


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of a table (null text: empty), whatever else it holds. Rows without an id have no result and are left out."""
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def squeezed(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` with the text compressed as ``packed``, for joins that must shuffle texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, packed binary")


def unsqueezed(packed: pa.Array) -> pa.Array:
    import zstandard

    tool = zstandard.ZstdDecompressor()
    return pa.array([tool.decompress(p).decode() for p in packed.to_pylist()], pa.large_string())

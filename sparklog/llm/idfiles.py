"""Token ids in files of fixed-width bit-packed blocks.

A file holds the ids of documents in ascending ``doc_id`` order:

``SLTK`` | version, bits (bytes) | block size, blocks (u32) | documents, ids (u64)
| doc_id of each document (i64) | first id of each document, and the end (u64)
| byte offset of each block in the payload, and the end (u64) | payload

Every id takes ``bits`` bits, the least that hold the vocabulary. A block is unpacked
with a few array operations; the offsets give any document or id without the rest.
A file's name is its writer's alone, and the manifest, made of the rows of the tasks that
count, lists the files; what a lost or doubled task wrote is in no manifest.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.llm import runtime
from sparklog.llm.kernels import parts
from sparklog.llm.tokens import ChunkEncoder

HEAD = struct.Struct("<4sBBxxIIQQ")
BLOCK = 4096
#: Ids gathered before a file is closed; a document's ids never lie in two files.
SHARD_IDS = 1 << 24
#: Ids that a task reads back, about: there is a file for each writer's task at least, and those may be small.
READ_IDS = 1 << 24


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of ``ids`` at ``bits`` bits each, in groups of 32 ids = ``bits`` 32-bit words."""
    groups = -(-len(ids) // 32)
    grid = np.zeros((groups, 32), np.uint64)
    grid.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits + 1), np.uint64)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        value = grid[:, j] << np.uint64(shift)
        out[:, word] |= value & np.uint64(0xFFFFFFFF)
        out[:, word + 1] |= value >> np.uint64(32)
    return out[:, :bits].astype("<u4").reshape(-1).view(np.uint8)


def unpack_ids(packed: np.ndarray, bits: int, n: int) -> np.ndarray:
    grid = packed.view("<u4").reshape(-1, bits).astype(np.uint64)
    wide = np.concatenate([grid, np.zeros((len(grid), 1), np.uint64)], axis=1)
    out = np.empty((len(grid), 32), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(32):
        word, shift = divmod(j * bits, 32)
        out[:, j] = ((wide[:, word] | (wide[:, word + 1] << np.uint64(32))) >> np.uint64(shift)) & mask
    return out.reshape(-1)[:n]


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    blocks = [pack_ids(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = HEAD.pack(b"SLTK", 1, bits, block, len(blocks), len(doc_ids), len(ids))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *(b.tobytes() for b in blocks)])


class IdFile:
    """Random access to one file's ids. Only the head and the asked blocks are read.

    source: the file's bytes, or an open file with ``seek`` and ``read``."""

    def __init__(self, source):
        self.source = io.BytesIO(source) if isinstance(source, bytes) else source
        magic, version, self.bits, self.block, blocks, docs, self.n_ids = HEAD.unpack(self._read(0, HEAD.size))
        if magic != b"SLTK" or version != 1:
            raise ValueError("not a token-id file")
        sizes = [8 * docs, 8 * (docs + 1), 8 * (blocks + 1)]
        ends = np.cumsum(sizes)
        table = self._read(HEAD.size, int(ends[-1]))
        ids, starts, offsets = (np.frombuffer(table[e - n : e], t) for e, n, t in zip(ends, sizes, ("<i8", "<u8", "<u8")))
        self.doc_ids, self.starts, self.offsets = ids, starts.astype(np.int64), offsets.astype(np.int64)
        self.payload = HEAD.size + int(ends[-1])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids number lo to hi-1; only their blocks are read and unpacked."""
        if hi <= lo:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        begin = int(self.offsets[first])
        packed = np.frombuffer(self._read(self.payload + begin, int(self.offsets[last + 1]) - begin), np.uint8)
        got = [unpack_ids(packed[self.offsets[b] - begin : self.offsets[b + 1] - begin], self.bits, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(got)[lo - first * self.block : hi - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


@contextmanager
def _small_scans(spark: SparkSession) -> Iterator[None]:
    """Meanwhile Parquet is read a few hundred rows at once: arrays of long texts by the thousand make the executors' heaps grow."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "512")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_token_files(docs: DataFrame, uri: str, vocabulary: str, end_id: int | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text of ``docs`` (null text: empty) and write its ids under ``uri`` in ascending ``doc_id`` order.

    Rows of one ``doc_id`` stay rows of their own, ordered by text. An empty table gives
    no file. Returns the manifest: one row per file with its place in the order.
    """
    spark = docs.sparkSession
    runtime.tune(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        bits = bits_for(tool.tokenizer.get_vocab_size())
        part, seq = TaskContext.get().partitionId(), 0
        fs, root = _filesystem(uri)
        fs.create_dir(root, recursive=True)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            # Every attempt of a task writes files of its own; the manifest names those of the one that counts.
            name = f"{root}/ids-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.sltk"
            with fs.open_output_stream(name) as f:
                f.write(encode_file(doc_ids, counts, ids, bits))
            return pa.RecordBatch.from_pydict({"file": [name], "part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]}, schema=MANIFEST)

        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, off, buf, rows in parts(batch.column(1)):
                ids, counts = tool.encode(rows, off, buf)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                held.append((doc_ids[lo:hi], counts, ids))
                if sum(len(x[2]) for x in held) >= shard_ids:
                    yield close()
                    seq += 1
        if held:
            yield close()

    # By doc_id alone: the sample that sets the ranges goes to the driver, and must not hold texts.
    ordered = runtime.texts(docs).repartitionByRange(runtime.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    with _small_scans(spark):
        made = ordered.mapInArrow(runtime.lean(write), "file string, part long, seq long, n_docs long, n_ids long").toArrow()
    # A row for each file, so few that one task writes them: on a local disk Spark starts a command or more for each file and folder it makes.
    return runtime.cut(spark.createDataFrame(made).coalesce(1), "manifest")


MANIFEST = pa.schema([("file", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_token_files(spark: SparkSession, manifest: DataFrame, uri: str) -> DataFrame:
    """Per document from the files alone: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(uri)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(name) as f:
                    held = IdFile(f)
                    crc = np.empty(len(held.doc_ids), np.int64)
                    step, at = 1 << 20, 0
                    while at < len(crc):  # runs of documents of about a million ids at once
                        end = max(at + 1, int(np.searchsorted(held.starts, held.starts[at] + step, side="right")) - 1)
                        end = min(end, len(crc))
                        raw = held.ids(int(held.starts[at]), int(held.starts[end])).astype("<u4")
                        for i in range(at, end):
                            crc[i] = zlib.crc32(raw[held.starts[i] - held.starts[at] : held.starts[i + 1] - held.starts[at]])
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array(np.array(held.doc_ids)), pa.array(held.starts[:-1] + base), pa.array(np.diff(held.starts)), pa.array(crc)], schema=schema)

    n_ids = manifest.agg(F.sum("n_ids")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-n_ids // READ_IDS))
    return placed.repartition(tasks).mapInArrow(runtime.lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")

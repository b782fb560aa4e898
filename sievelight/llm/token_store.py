"""Token ids in files of fixed-width packed bits.

A file holds the ids of consecutive documents (ascending ``doc_id``), each id in
the fewest bits that the vocabulary needs. Layout, little-endian:

    magic  8 bytes  b"SVLTOK01"
    header          bits u32, block u32 (ids in a block), documents u64, ids u64
    doc_ids         documents x i64
    null flags      documents x u8 (1: the document's id is null)
    ends            documents x u64, ids up to and with each document
    block offsets   (blocks + 1) x u64, bytes from the start of the payload
    payload         blocks of packed bits, first id in the lowest bits

Blocks begin at whole bytes, so any range of ids is read by unpacking only the
blocks that hold it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, new_folder, staged
from .encoding import library_encoder, texts_of

MAGIC = b"SVLTOK01"
_HEAD = struct.Struct("<8sIIQQ")
BLOCK = 4096

#: Bytes of text that go into one file, so that a task holds a file whole.
FILE_TEXT_BYTES = 24 << 20
#: Rows of numbers and sizes that one task sums up when files are laid out.
LAID_OUT = 1_000_000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below the vocabulary's size."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 32:
        return ids.astype("<u4").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", count).astype("<u4")
    if bits == 32:
        return np.frombuffer(data, "<u4", count)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    return (planes.astype(np.uint64) @ weights).astype("<u4")


def build_file(doc_ids: list[int | None], documents: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    """A file image of documents' ids (each as uint32 bytes)."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = [pack_bits(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    parts = [
        _HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids)),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.cumsum([len(d) // 4 for d in documents], dtype="<u8").tobytes(),
        np.cumsum([0, *map(len, blocks)], dtype="<u8").tobytes(),
        *blocks,
    ]
    return b"".join(parts)


class TokenFile:
    """Random access to a file image."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, self.n_docs, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self._data = memoryview(data)
        at = _HEAD.size
        take = lambda kind, n: np.frombuffer(data, kind, n, at)
        ids = take("<i8", self.n_docs)
        at += 8 * self.n_docs
        nulls = take("u1", self.n_docs)
        at += self.n_docs
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, nulls, strict=True)]
        self.ends = take("<u8", self.n_docs).astype(np.int64)
        at += 8 * self.n_docs
        n_blocks = -(-self.n_ids // self.block)
        self._offsets = take("<u8", n_blocks + 1).astype(np.int64)
        self._payload = at + 8 * (n_blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; reads only the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        found = [
            unpack_bits(self._data[self._payload + self._offsets[b] : self._payload + self._offsets[b + 1]], self.bits, min(self.block, self.n_ids - b * self.block))
            for b in range(first, last + 1)
        ]
        return np.concatenate(found)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def file_bounds(sizes: DataFrame, most: int = FILE_TEXT_BYTES) -> list[int]:
    """First ``doc_id`` of every file, so that a file's texts have ``most`` bytes and one document's more at most.

    ``sizes`` has ``doc_id`` (not null) and ``bytes``. Only a row per file and
    one per range of ``LAID_OUT`` documents reach the driver.
    """
    n = sizes.count()
    ranges = sizes.repartitionByRange(max(1, -(-n // LAID_OUT)), "doc_id").withColumn("part", F.spark_partition_id())
    ranges = staged(ranges, "token-sizes")
    before, offsets = 0, []
    for r in ranges.groupBy("part").agg(F.sum("bytes").alias("bytes")).orderBy("part").collect():
        offsets.append((r.part, before))
        before += r.bytes
    if not offsets:
        return []
    offsets = F.broadcast(sizes.sparkSession.createDataFrame(offsets, "part int, before long"))
    upto = F.sum("bytes").over(Window.partitionBy("part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    file = F.floor((F.col("before") + F.coalesce(upto, F.lit(0))) / most)
    firsts = ranges.join(offsets, "part").withColumn("file", file).groupBy("file").agg(F.min("doc_id").alias("first"))
    bounds = sorted({r.first for r in firsts.select("first").collect()})
    discard(ranges)
    return bounds


def write_tokens(documents: DataFrame, vocabulary_path: str, end_id: int, folder: str | None = None, text: str = "text") -> DataFrame:
    """Encode every whole text and write token files in ascending ``doc_id`` order.

    Returns the manifest: one row per file with ``part`` (order of the files),
    ``file``, ``n_docs``, ``n_ids`` and ``start`` (ids of all files before it).
    Null texts are encoded as empty ones, so each document has at least its end
    id. Rows with null or repeated ``doc_id`` are kept; null ids come first, and
    rows of one ``doc_id`` are in one file. Files are cut by bytes of text. A
    task writes under a name of its own attempt and the manifest lists only the
    files of attempts that ended well, so a repeated task leaves no trace. Only
    ``doc_id`` and the text are read, whatever other columns there are; a text is
    encoded whole and may fill blocks of its own; an empty table gives an empty
    manifest.
    """
    spark = documents.sparkSession
    folder = (folder or new_folder(spark, "tokens")).rstrip("/")
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())  # a fixed public file of under two megabytes
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    bounds = file_bounds(rows.select(place.alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")))
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64))  # a number per file

    @F.pandas_udf("int")
    def file_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(), "right") - 1).astype("int32")

    ordered = rows.repartitionById(max(1, len(bounds)), file_of(place)).sortWithinPartitions("doc_id")

    def write(batches):
        encoder = library_encoder(vocabulary.value)
        end = np.array([end_id], "<u4").tobytes()
        doc_ids, documents = [], []
        for batch in batches:
            doc_ids += batch.column(0).to_pylist()
            documents += [encoder.encode(t) + end for t in texts_of(batch.column(1))]
        encoder.forget()
        if not doc_ids:
            return
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.tok"
        files, path = _filesystem(name)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as out:
            out.write(build_file(doc_ids, documents, bits_for(max(encoder.vocab_size, end_id + 1))))
        yield pa.RecordBatch.from_pydict(
            {"part": [context.partitionId()], "file": [name.rpartition("/")[2]], "n_docs": [len(doc_ids)], "n_ids": [sum(map(len, documents)) // 4]},
            schema=pa.schema([("part", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    written = ordered.mapInArrow(write, "part long, file string, n_docs long, n_ids long").collect()  # a row per file
    start, rows = 0, []
    for r in sorted(written, key=lambda r: r.part):
        rows.append((r.part, f"{folder}/{r.file}", r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "part long, file string, n_docs long, n_ids long, start long")


def read_tokens(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the manifest's files: ``doc_id, start, n_tokens, ids`` (binary uint32)."""
    listed = manifest.select("file", "start").collect()  # a row per file of tens of megabytes
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not listed:
        return spark.createDataFrame([], schema)
    base = spark.sparkContext.broadcast({r.file.rpartition("/")[2]: r.start for r in listed})
    files = spark.read.format("binaryFile").load([r.file for r in listed]).select("path", "content")

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file, first = TokenFile(content.as_py()), base.value[path.rpartition("/")[2]]
                ends = file.ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                for at in range(0, file.n_docs, 1024):
                    to = min(file.n_docs, at + 1024)
                    low = int(starts[at])
                    ids = file.ids(low, int(ends[to - 1]))
                    own = [ids[starts[i] - low : ends[i] - low].tobytes() for i in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids[at:to], pa.int64()), pa.array(first + starts[at:to]), pa.array(ends[at:to] - starts[at:to]), pa.array(own, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                    )

    return files.mapInArrow(read, schema)


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids)

"""Token files of independent zstandard frames with a trailing seek table.

A file is a run of frames in the public seekable zstandard layout: each frame holds the ids of a block of whole documents as
little-endian unsigned 32-bit integers and decompresses alone; the last frame is skippable and lists every frame's compressed
size, decompressed size and checksum (low 32 bits of XXH64 of the decompressed bytes). Before it stands one more skippable frame
with the directory: for each document its key, the frame it is in and its ids' place there. Any zstandard reader can decompress
a file; a reader of single documents fetches the end of the file and then the frames it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import partitions, scratch_path, text_or_empty, texts_of
from assayer.llm.pretokens import Encoder

SEEK_MAGIC, FOOTER_MAGIC, DIRECTORY_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50  # fixed values of the format
FRAME_IDS = 1 << 18  # a frame closes when it holds so many ids; a longer document has a frame of its own
LEVEL = 1
END_ID = 2
DIRECTORY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("start", "<u4"), ("n", "<u4")])
FILE_SCHEMA = "shard int, path string, documents long, ids long"


class FrameWriter:
    """Writes one file; ``finish`` returns nothing, the caller names the file."""

    def __init__(self, sink, level: int = LEVEL):
        self.sink, self.codec = sink, zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.frames: list[tuple[int, int, int]] = []
        self.directory: list[tuple] = []
        self.parts: list[np.ndarray] = []
        self.held = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held + len(ids) > FRAME_IDS:
            self._close()
        self.directory.append((doc_id or 0, doc_id is None, len(self.frames), self.held, len(ids)))
        self.parts.append(ids)
        self.held += len(ids)
        self.ids += len(ids)

    def _close(self) -> None:
        raw = np.concatenate(self.parts).astype("<u4").tobytes()
        packed = self.codec.compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def finish(self) -> None:
        if self.parts:
            self._close()
        listing = self.codec.compress(np.array(self.directory, DIRECTORY).tobytes())
        self.sink.write(struct.pack("<II", DIRECTORY_MAGIC, len(listing) + 4) + listing + struct.pack("<I", len(listing)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Reads single documents, or all in order, from a seekable binary file."""

    def __init__(self, source):
        self.source = source
        size = source.seek(0, 2) or source.tell()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != FOOTER_MAGIC or flags != 0x80:
            raise ValueError("not a file of seekable frames")
        at = size - 9 - 12 * n
        self.table = np.frombuffer(self._read(at, 12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        (listed,) = struct.unpack("<I", self._read(at - 12, 4))
        packed = self._read(at - 12 - listed, listed)
        self.directory = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), DIRECTORY)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = (int(x) for x in self.table[k])
        raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.starts[k]), packed), max_output_size=max(size, 1))
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def document(self, row: int) -> np.ndarray:
        """The ids of the row-th document; decompresses its frame alone."""
        entry = self.directory[row]
        return self.frame(int(entry["frame"]))[int(entry["start"]) : int(entry["start"]) + int(entry["n"])]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents, one frame in memory at a time."""
        now, ids = -1, np.empty(0, "<u4")
        for doc_id, null, k, start, n in self.directory.tolist():
            if k != now:
                now, ids = k, self.frame(k)
            yield (None if null else doc_id), ids[start : start + n]


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Encode every text and write its ids, ``end_id`` last, in ascending (doc_id, text) order; null ids come first.

    Returns one row for each file (FILE_SCHEMA), by shard in order. Documents are dealt by ranges of (doc_id, text hash), so
    only wholly equal rows must share a file. Each task attempt writes a file of its own name and the written index names the
    attempt that counted, so lost executors, retries and speculation leave no half file in use. A null text is empty and has
    the end id alone; repeated rows are written as often as they occur.
    """
    spark = docs.sparkSession
    n = partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        task = TaskContext.get()
        name = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}.zst"
        system, place = pa.fs.FileSystem.from_uri(name)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        documents = 0
        with system.open_output_stream(place, compression=None) as sink:
            writer = FrameWriter(sink)
            for batch in batches:
                keys = batch.column("doc_id").to_pylist()
                for low, high, data, offsets in texts_of(batch):
                    ids, at = encoder.encode(data, offsets)
                    for row in range(high - low):
                        writer.add(keys[low + row], np.append(ids[at[row] : at[row + 1]], np.uint32(end_id)))
                    documents += high - low
            writer.finish()
        if documents:
            yield pa.RecordBatch.from_pydict(
                {"shard": pa.array([task.partitionId()], pa.int32()), "path": [name], "documents": [documents], "ids": [writer.ids]},
            )

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text))
        .withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    )
    index = f"{folder}/index"
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(index)
    return spark.read.schema(FILE_SCHEMA).parquet(index)


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document (doc_id, start, n_tokens, ids_crc32) from the files of ``write_token_files``, one file to a task.

    ``start``: ids of all documents before it. The driver gets one row for each file.
    """
    spark = files.sparkSession
    listed = files.orderBy("shard").collect()
    before, rows = 0, []
    for f in listed:
        rows.append((f["path"], before))
        before += f["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist(), strict=True):
                system, place = pa.fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as source:
                    got = []
                    for doc_id, ids in FrameReader(source).documents():
                        got.append((doc_id, start, len(ids), zlib.crc32(ids)))
                        start += len(ids)
                    columns = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listing = spark.createDataFrame(rows, "path string, before long").repartition(max(1, len(rows)))
    return listing.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, spark: SparkSession, text: str = "text") -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return what they hold, read back."""
    return read_token_files(write_token_files(docs, path, scratch_path(spark, "tokens"), text=text))

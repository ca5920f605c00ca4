"""Helpers the operators share: shared scratch tables, Arrow texts as bytes, substring hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.session import ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"  # a word of the contracts: a run without ASCII white space
CHUNK_BYTES = 1 << 19  # text that one round of array work holds; a longer text makes a round of its own


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: lost executors cost nothing, later steps prune columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias("text")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and the n + 1 offsets of its rows (null: empty)."""
    column = pc.fill_null(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, values = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, a longer row alone."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for each round of array work over a batch."""
    data, offsets = utf8(batch.column(name))
    for low, high in slices(offsets):
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, so that any bits of a polynomial hash are usable."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Prefixes:
    """Rolling polynomial hashes modulo 2**64: after one pass, the hash of any range takes one subtraction."""

    BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 modulo 8, so that powers are of long period
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C13, -1, 1 << 64))
    BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray):
        """``values``: bytes, or 64-bit numbers that are already well mixed."""
        n = len(values)
        if len(Prefixes._powers) <= n:
            size = 1 << max(16, int(n).bit_length())
            Prefixes._powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, self.BASE)]), dtype=np.uint64)
            Prefixes._inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, self.INVERSE)]), dtype=np.uint64)
        values = self.BYTES[values] if values.dtype == np.uint8 else values
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * Prefixes._powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the ranges [start, end), their lengths mixed in."""
        return mixed((self.sums[end] - self.sums[start]) * Prefixes._inverses[start] + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in the bytes, and each row's range in them (n + 1 numbers)."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's end also ends its last word
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a flag or count array over each row's range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[offsets])

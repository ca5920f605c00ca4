"""Token counts by a map-side two-tier lookup.

Tier one is a compact hash table of the lengths of frequent pre-tokens, learned once and broadcast; tier two is a cache that each
worker keeps of pre-tokens it has met, filled by the tokenizers library. No pre-token is shuffled, and no tier changes a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Prefixes, per_row, text_or_empty, texts_of
from assayer.llm.pretokens import Encoder, HashTable

SAMPLE_ROWS = 4_000  # documents (at most about so many) that tier one is learned from
FREQUENT = 1 << 16  # entries of tier one: under 2 MB whatever the input
LIMIT = 512


def frequent_lengths(docs: DataFrame, path: str, text: str = "text", rows: int = SAMPLE_ROWS, size: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys and token lengths of the most frequent pre-tokens of a bounded sample.

    The sample decides only what is looked up fast, never a count. Each task sends at most ``size`` distinct keys, added up by
    key; the driver gets the ``size`` most frequent.
    """
    total = docs.count()
    sample = docs.select(text_or_empty(text)).sample(min(1.0, rows / max(total, 1)), seed=7)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            for _, _, data, offsets in texts_of(batch):
                starts, _ = encoder.cutter.cut(data, offsets)
                if len(starts):
                    ends = np.append(starts[1:], len(data))
                    rows = encoder.rows(data, starts)
                    lengths = encoder.bounds[rows + 1] - encoder.bounds[rows]
                    keys, first, n = np.unique(Prefixes(data).of(starts, ends) | np.uint64(1), return_index=True, return_counts=True)
                    most = np.argsort(-n, kind="stable")[:size]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[most].view(np.int64)), pa.array(lengths[first[most]]), pa.array(n[most])], names=["key", "length", "n"],
                    )

    top = sample.mapInArrow(count, "key long, length long, n long").groupBy("key", "length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(size)
    got = top.select("key", "length").toPandas()
    return got["key"].to_numpy(np.int64).view(np.uint64), got["length"].to_numpy(np.int64)


def count_tokens(
    docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
    frequent: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """UTF-8 bytes and tokens of each whole text, as the library gives them for the vocabulary file at ``path``.

    A map over the scan. A null or empty text has 0 of both. Special strings inside texts are treated as the library does by
    default. Columns beyond ``keep`` are ignored, also such with names of the result; repeated rows give repeated results.
    """
    keys, lengths = frequent_lengths(docs, path, text) if frequent is None else frequent
    table = HashTable(max(len(keys), 1))
    table.add(keys, np.arange(len(keys), dtype=np.int32))
    shared = docs.sparkSession.sparkContext.broadcast((table, lengths.astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, known = shared.value
        encoder = Encoder.at(path)
        for batch in batches:
            carried = [batch.column(c) for c in keep]
            for low, high, data, offsets in texts_of(batch):
                starts, bounds = encoder.cutter.cut(data, offsets)
                n = np.zeros(len(starts), np.int64)
                if len(starts):
                    ends = np.append(starts[1:], len(data))
                    at = first.find(Prefixes(data).of(starts, ends) | np.uint64(1))
                    hit = at >= 0
                    n[hit] = known[at[hit]]
                    missed = np.flatnonzero(~hit)
                    if len(missed):  # the misses, end to end, go through the worker's cache
                        size = (ends - starts)[missed]
                        began = np.cumsum(size) - size
                        rest = data[np.repeat(starts[missed] - began, size) + np.arange(size.sum())]
                        rows = encoder.rows(rest, began)
                        n[missed] = encoder.bounds[rows + 1] - encoder.bounds[rows]
                counts = per_row(n, bounds)
                for row in encoder.special(data, offsets):
                    counts[row] = len(encoder.whole(data[offsets[row] : offsets[row + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(low, high - low) for c in carried] + [pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)],
                    names=[*keep, "n_bytes", "n_tokens", "over_limit"],
                )

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*[F.col(c) for c in keep], text_or_empty(text)).mapInArrow(run, f"{carried}, n_bytes long, n_tokens long, over_limit boolean")

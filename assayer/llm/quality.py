"""Quality rules by repetition coverage.

``repetition_quality`` hashes the words of each text once, takes rolling hashes of several n-gram lengths over them, and
measures which share of the characters lies inside n-grams or lines that the same text repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import SPACE, Prefixes, mixed, per_row, text_or_empty, texts_of, word_bounds

SYMBOLS = "#*$%&|<>"
LENGTHS = (5, 7, 10)  # words; the first is the base rule's
MAX_COVERED = 0.20  # share of a text's word characters inside repeated n-grams, for each length
MAX_LINES = 0.20  # share inside lines that repeat an earlier one
MAX_SYMBOLS = 0.25  # symbols a word
MIN_WORDS = 10

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    + ", ".join(f"covered_{n} double" for n in LENGTHS) + ", covered_lines double"
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur more than once, and which repeat an earlier one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    later, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    return shared, later


def _spread(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the words in any of the windows [start, start + width)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + width, -1)
    return np.cumsum(step[:-1]) > 0


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of SCHEMA for texts that lie end to end."""
    rows = len(offsets) - 1
    starts, ends, words = word_bounds(data, offsets)
    n_words = np.diff(words)
    doc = np.repeat(np.arange(rows), n_words)
    salt = mixed(np.arange(1, rows + 1, dtype=np.uint64))
    character = (data & 0xC0) != 0x80
    lengths = Prefixes(data)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(character, out=sums[1:])
    chars = sums[ends] - sums[starts]
    word_chars = per_row(chars, words)
    hashes = Prefixes(lengths.of(starts, ends))
    left = np.repeat(words[1:], n_words) - np.arange(len(starts))  # words from here to the text's end

    out: dict[str, np.ndarray] = {"n_words": n_words, "word_chars": word_chars, "n_symbols": per_row(_SYMBOL[data], offsets)}
    shared = np.zeros(len(starts), bool)
    shares = {}
    for n in LENGTHS:
        at = np.flatnonzero(left >= n)
        if n > LENGTHS[0]:  # a repeated longer window begins and ends with a repeated shorter one
            at = at[shared[at] & shared[at + n - LENGTHS[0]]]
        found, _ = _repeated(hashes.of(at, at + n) ^ salt[doc[at]])
        if n == LENGTHS[0]:
            shared[at] = found
        inside = _spread(at[found], n, len(starts))
        if n == LENGTHS[0]:
            out["n_repeat_words"] = per_row(inside, words)
        shares[n] = per_row(np.where(inside, chars, 0), words) / np.maximum(word_chars, 1)

    breaks = np.flatnonzero(data == 10)
    low = np.union1d(offsets[:-1], breaks + 1)
    low = low[low < len(data)]
    line_doc = np.searchsorted(offsets, low, "right") - 1
    high = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, low)], offsets[line_doc + 1])
    held = np.searchsorted(starts, high) > np.searchsorted(starts, low)
    low, high, line_doc = low[held], high[held], line_doc[held]
    _, later = _repeated(lengths.of(low, high) ^ salt[line_doc])
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=rows)
    solid = np.zeros(len(data) + 1, np.int64)
    np.cumsum(character & ~SPACE[data], out=solid[1:])
    in_lines = np.bincount(line_doc[later], (solid[high] - solid[low])[later], minlength=rows) / np.maximum(word_chars, 1)

    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 20 * n_words)
    good = (in_lines <= MAX_LINES) & (out["n_symbols"] <= MAX_SYMBOLS * n_words)
    for n in LENGTHS:
        good &= shares[n] <= MAX_COVERED
        out[f"covered_{n}"] = shares[n]
    out["covered_lines"] = in_lines
    out["kept"] = ~out["base_failed"] & good
    return out


def repetition_quality(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures and verdict for each row; one map over the scan, nothing is shuffled.

    ``keep`` columns are carried along; other columns, also such with names of the result, are ignored. A null or blank text
    has no words and fails. A text is measured whole; work goes by rounds of CHUNK_BYTES, a longer text alone. Repeated rows
    give repeated results; an empty table gives none.
    """
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = [batch.column(c) for c in keep]
            for low, high, data, offsets in texts_of(batch):
                got = measure(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(low, high - low) for c in carried] + [pa.array(got[n]) for n in names], names=[*keep, *names],
                )

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*[F.col(c) for c in keep], text_or_empty(text)).mapInArrow(run, f"{carried}, {SCHEMA}")


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose verdict is to keep, with the same columns; a map over the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [measure(data, offsets)["kept"] for _, _, data, offsets in texts_of(batch, text)]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return docs.mapInArrow(run, docs.schema)

"""Spelling variants through pivotal grams.

Words within one edit are found without comparing all of them. A word's bigrams are ordered by rarity; its *prefix* is what comes up
to the third of them, and two disjoint bigrams of that prefix, chosen by dynamic programming for the least frequency, are its
*pivots*. One edit cannot touch both pivots, so of two near words one has a pivot that the other holds in its prefix. A pivot that
is intact lies on one side of the edit: what stands on its other side is intact as well and the pivot's place moves by the change of
length or not at all. These position limits make the keys, and what meets under a key is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import text_or_empty, written

EDITS = 1
GRAM = 2  # characters
LEAST_LETTERS, LEAST_COUNT = 6, 5
RATIO = 5  # a form is this many times as frequent as its variants
SLIPS = 199  # one of so many (document, run) pairs loses a letter
FLUSH = 1 << 17  # distinct words a task counts before it passes them on
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def _lower(text: str) -> str:
    return text.encode().lower().decode()  # bytes fold A-Z only


def tally(doc_id: int | None, text: str) -> Counter:
    """Words of one text with their counts, after the slips that the document's id decides; shorter ones are left out."""
    salt = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found = Counter()
    for run, n in Counter(_RUN.findall(_lower(text))).items():
        h = zlib.crc32(run.encode(), salt)
        if h % SLIPS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LETTERS:
            found[run] += n
    return found


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of the words with LEAST_COUNT occurrences or more; counts combine in the tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for word, n in tally(doc, body).items():
                    held[word] += n
                if len(held) >= FLUSH:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text))
    return keys.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def prefix_and_pivots(word: str, counts: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of the prefix grams and, among them, of the EDITS + 1 disjoint ones of least total frequency."""
    found = grams(word)
    order = sorted(range(len(found)), key=lambda i: (counts[found[i]], found[i], i))
    last = order[min(GRAM * EDITS, len(order) - 1)]
    limit = (counts[found[last]], found[last])
    prefix = [i for i in range(len(found)) if (counts[found[i]], found[i]) <= limit]  # a repeated last gram counts wholly
    best: list[list[tuple[int, tuple[int, ...]]]] = [[(0, ())] + [(1 << 62, ())] * (EDITS + 1)]
    for k, at in enumerate(prefix):  # best[k][m]: m disjoint grams among the first k
        free = sum(p <= at - GRAM for p in prefix[:k])
        best.append([min(best[k][m], (best[free][m - 1][0] + counts[found[at]], (*best[free][m - 1][1], at))) if m else best[k][0] for m in range(EDITS + 2)])
    return prefix, list(best[-1][EDITS + 1][1])


def keys(word: str, places: list[int], pivots: bool) -> set[int]:
    """Keys a word looks up by its pivots, or under which it can be found by its prefix grams.

    The intact gram is behind the edit or before it, so the word's end from the gram on, or its beginning up to the gram, is intact.
    Where that part is less than half of the indexed word, the stretch with the edit is halved and one half is intact as well. Every
    key thus holds about half of a word or more, with both lengths and the gram's distance from the intact end.
    """
    found = set()
    for at in places:
        for d in (-EDITS, 0, EDITS):
            own, other = len(word), len(word) + d
            held = other if pivots else own  # length of the indexed word
            base = min(own, other)
            for side, k in (("<", at + GRAM), (">", own - at)):
                if 2 * k >= held:
                    parts = [(word[:k] if side == "<" else word[own - k :], "")]
                elif side == "<":
                    m = (k + base + 1) // 2
                    parts = [(word[:m], ""), (word[:k], word[own - base + m :])]
                else:
                    m = (base - k) // 2
                    parts = [(word[:m], word[own - k :]), ("", word[own - base + m :])]
                tag = f"{side}{k}:{held}:" if 2 * k >= held else f"{side}{k}:{held}:{own if pivots else other}:"
                found.update(xxhash.xxh64_intdigest(f"{tag}{x}|{y}") for x, y in parts)
    return {h - (1 << 64) if h >> 63 else h for h in found}


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a < b: the pairs of ``words`` (word, n) that differ by exactly one edit, once each.

    The table of gram counts has a row for each pair of the 90 letters at most and is sent to all tasks. Each word gives some 20
    look-ups and as many index rows; candidates are verified inside the join and never become rows.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1), lambda i: F.substring(F.col("word"), i, GRAM))
    counts = {r["gram"]: r["n"] for r in words.select(F.explode(pairs).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: tuple[list[list[int]], list[list[int]]] = ([], [])
            for word in batch.column("word").to_pylist():
                prefix, pivots = prefix_and_pivots(word, counts)
                found[0].append(sorted(keys(word, prefix, pivots=False)))
                found[1].append(sorted(keys(word, pivots, pivots=True)))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(found[0], kind), pa.array(found[1], kind)], names=["word", "n", "held", "sought"])

    keyed = written(words.mapInArrow(run, "word string, n long, held array<long>, sought array<long>"), "grams")
    left = keyed.select(F.explode("sought").alias("key"), F.col("word").alias("x"), F.col("n").alias("n_x"))
    right = keyed.select(F.explode("held").alias("key"), F.col("word").alias("y"), F.col("n").alias("n_y"))
    met = left.join(right, (left["key"] == right["key"]) & (F.levenshtein("x", "y", EDITS) == EDITS))
    swap = F.col("x") > F.col("y")
    return met.select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"),
    ).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the end of each chain. A form is RATIO times as frequent, so chains are short and free
    of cycles; each round doubles the steps taken."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of LEAST_LETTERS letters and LEAST_COUNT occurrences or more.

    Runs of letters are taken from whole texts with A-Z folded; a null text has none, a null doc_id counts as an empty one in the
    slips. ``form`` is the near word of largest n (ties: the smaller in code-point order) if it is RATIO times as frequent.
    Repeated rows count as often as they occur, other columns are ignored, an empty table gives no rows.
    """
    words = written(word_counts(docs, text), "words")
    pairs = written(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")).union(
        pairs.select("b", "n_b", "a", "n_a"))
    order = F.struct(-F.col("near_n"), F.col("near"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), order).alias("best"))
    formed = F.col("best.near_n") >= RATIO * F.col("n")
    told = written(words.join(best, "word", "left").select(
        "word", F.when(formed, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best.near_n")).alias("form_n"),
    ), "forms")
    ends = roots(told.where("form is not null").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

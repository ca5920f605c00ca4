"""Benchmark decontamination by CGK embeddings.

A CGK walk reads a sequence of words through a pointer that at each step stays or moves on, as a random bit of the step and of the
word under it says; it writes that word at every step. Walks that begin at matching words and meet few edits run together again,
so small edit distance becomes small Hamming distance of what they write. Locality-sensitive hashing samples steps of the walk;
independent repetitions reach the target recall. Candidates are verified by exact edit distance over item-sized windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import Prefixes, mixed, per_row, slices, text_or_empty, texts_of, word_bounds
from assayer.llm.pretokens import HashTable

SIMILARITY = 0.8  # 1 - word edits / words of the item
MIN_WORDS = 5  # an item of fewer words allows no edit: it is looked up whole, not by walks
STEPS, SAMPLED = 8, 5  # of a walk, and of them in one hash; the first step is always sampled
RECALL = 0.99  # of matches at the edit limit, spread against us
MOST_REPETITIONS = 64
WINDOW_WORDS = 1 << 20  # of candidates that are looked up at once
BLOCK_WORDS = 1 << 20  # item words that are searched for at once: their index is broadcast, a few tens of MB at most


def _lowered(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of texts end to end, and each row's range in them."""
    starts, ends, bounds = word_bounds(data, offsets)
    return Prefixes(_lowered(data)).of(starts, ends) | np.uint64(1), bounds


def edits(n: int) -> int:
    """Word edits that an item of n words may differ by."""
    return int((1 - SIMILARITY) * n + 1e-9)


def repetition_steps(size: int, recall: float = RECALL) -> list[np.ndarray]:
    """Sampled steps of as many repetitions as the recall of items of that many words takes.

    e edits leave one of e + 1 stretches with at least s = (n - e) / (e + 1) words. A repetition finds a match at a stretch if
    the pointer, which moves with probability 1/2 a step, is still within it at the last sampled step; stretches and repetitions
    miss independently.
    """
    e = edits(size)
    s = max(1, (size - e) // (e + 1))
    random = np.random.default_rng(20)
    out: list[np.ndarray] = []
    missed = 0.0
    while not out or missed > log(1 - recall) and len(out) < MOST_REPETITIONS:
        steps = np.concatenate([[0], 1 + np.sort(random.choice(STEPS - 1, SAMPLED - 1, replace=False))])
        last = int(steps[-1])
        held = sum(comb(last, k) for k in range(min(last, s - 1) + 1)) / 2**last
        missed += (e + 1) * log(1 - held) if held < 1 else 2 * log(1 - recall)
        out.append(steps)
    return out


def walk(words: np.ndarray, end: np.ndarray, at: np.ndarray, steps: np.ndarray, seed: int) -> np.ndarray:
    """LSH keys of the walks that begin at positions ``at``; ``end``: where each position's text ends."""
    moves = mixed(words ^ np.uint64(0x5851F42D4C957F2D * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF))
    moves, seen = np.append(moves, np.uint64(0)), np.append(words, np.uint64(0))
    stop, here = end[at], at.copy()
    key = np.full(len(at), np.uint64(seed + 1))
    sampled = set(steps.tolist())
    for j in range(int(steps[-1]) + 1):
        inside = here < stop
        where = np.where(inside, here, len(words))  # past the end a walk writes 0 and stays
        if j in sampled:
            key = key * np.uint64(0x9E3779B97F4A7C15) + seen[where]
        here = here + ((moves[where] >> np.uint64(j)) & np.uint64(1)).astype(np.int64)
    return mixed(key) | np.uint64(1)


def sequence(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n words at and behind each position."""
    key = np.full(len(at), np.uint64(n))
    for j in range(n):
        key = key * np.uint64(0x9E3779B97F4A7C15) + words[at + j]
    return mixed(key) | np.uint64(1)


def nearest(item: list[int], window: list[int], limit: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of the window nearest to the item, if within the limit; bit-parallel columns.

    The end comes from a scan over the window, the start from a scan backwards from that end; of equal ends the first counts.
    """

    def scan(pattern: list[int], text: list[int], free_start: bool) -> tuple[int, int]:
        n = len(pattern)
        masks: dict[int, int] = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        full, top = (1 << n) - 1, 1 << (n - 1)
        up, down, score, best, at = full, 0, n, n, 0
        for j, w in enumerate(text):
            eq = masks.get(w, 0)
            x = eq | down
            d0 = (((x & up) + up) ^ up) | x
            plus, minus = down | (~(d0 | up) & full), up & d0
            score += 1 if plus & top else -1 if minus & top else 0
            plus = (plus << 1 | (0 if free_start else 1)) & full
            minus = minus << 1 & full
            up, down = minus | (~(d0 | plus) & full), plus & d0
            if score < best:
                best, at = score, j + 1
        return best, at

    distance, end = scan(item, window, True)
    if distance > limit:
        return None
    _, back = scan(item[::-1], window[:end][::-1], False)
    return distance, end - back, end


def _member(words: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mixed(words ^ mixed(item.astype(np.uint64) + np.uint64(1))) | np.uint64(1)


@dataclass
class Index:
    """Benchmark items and the LSH keys of every place in them, to be broadcast."""

    ids: list[int | None]
    words: list[np.ndarray]
    steps: list[np.ndarray]
    tables: list[HashTable]  # key -> group of places, one table a repetition
    bounds: list[np.ndarray]
    places: list[np.ndarray]  # (item, offset)
    vocabulary: HashTable
    members: HashTable  # (item, word)
    sizes: np.ndarray
    slack: np.ndarray
    short: dict[int, tuple[HashTable, list[np.ndarray]]]  # words -> sequence key -> the items of that sequence

    @classmethod
    def of(cls, items: list[tuple[int | None, np.ndarray]]) -> Index:
        ids, words = [i for i, _ in items], [w for _, w in items]
        flat = np.concatenate(words)
        sizes = np.array([len(w) for w in words])
        ends = np.cumsum(sizes)
        item = np.repeat(np.arange(len(words)), sizes)
        offset = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
        long = np.flatnonzero(sizes[item] >= MIN_WORDS)
        # The need is not monotone in the length, so every length of the block has its say.
        steps = max((repetition_steps(int(n)) for n in np.unique(sizes[item[long]])), key=len, default=[])
        tables, bounds, places = [], [], []
        for seed, chosen in enumerate(steps):
            keys = walk(flat, ends[item], long, chosen, seed)
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            table = HashTable(len(distinct))
            table.add(distinct, np.arange(len(distinct), dtype=np.int32))
            tables.append(table)
            bounds.append(np.append(first, len(keys)))
            places.append(np.stack([item[long[order]], offset[long[order]]], axis=1))
        known = np.unique(flat[long])
        vocabulary = HashTable(len(known))
        vocabulary.add(known, np.arange(len(known), dtype=np.int32))
        held = np.unique(_member(flat[long], item[long]))
        members = HashTable(len(held))
        members.add(held, np.arange(len(held), dtype=np.int32))
        short = {}
        for n in np.unique(sizes[sizes < MIN_WORDS]).tolist():
            mine = np.flatnonzero(sizes == n)
            keys = sequence(flat, ends[mine] - n, n)
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            table = HashTable(len(distinct))
            table.add(distinct, np.arange(len(distinct), dtype=np.int32))
            short[n] = table, np.split(mine[order], first[1:])
        return cls(ids, words, steps, tables, bounds, places, vocabulary, members, sizes, np.array([edits(int(n)) for n in sizes]), short)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, end word) for every item that a row holds, its nearest place each."""
        sizes = np.diff(bounds)
        end = np.repeat(bounds[1:], sizes)
        begin = np.flatnonzero(self.vocabulary.find(words) >= 0)  # a walk writes its first word, so it is one of an item's
        pairs = [np.empty((0, 2), np.int64)]
        for seed, steps in enumerate(self.steps):
            group = self.tables[seed].find(walk(words, end, begin, steps, seed)) if len(begin) else np.empty(0, np.int32)
            hit = np.flatnonzero(group >= 0)
            low = self.bounds[seed][group[hit]]
            n = self.bounds[seed][group[hit] + 1] - low
            which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            place = self.places[seed][which]
            pairs.append(np.stack([np.repeat(begin[hit], n) - place[:, 1], place[:, 0]], axis=1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return self._verified(words, bounds, pairs[:, 0], pairs[:, 1]) + self._verbatim(words, bounds, end)

    def _verbatim(self, words: np.ndarray, bounds: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Every short item that stands word for word in a row, its first place."""
        found = []
        for n, (table, items) in self.short.items():
            at = np.flatnonzero(np.arange(n, len(words) + n) <= end)
            group = table.find(sequence(words, at, n))
            at, group = at[group >= 0], group[group >= 0]
            row = np.searchsorted(bounds, at, "right") - 1
            _, first = np.unique(row * len(items) + group, return_index=True)  # places ascend, so the first one
            for r, g, a in zip(row[first].tolist(), group[first].tolist(), at[first].tolist(), strict=True):
                said = words[a : a + n]
                found += [(r, int(k), 0, a - int(bounds[r]), a - int(bounds[r]) + n) for k in items[g] if np.array_equal(self.words[k], said)]
        return found

    def _windows(self, words: np.ndarray, start: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, low, high) of the windows to look at: overlapping places of one item are one, and those too poor in its words go.

        An item within the limit finds all but so many of its words in the window.
        """
        order = np.lexsort((start, item))
        start, item = start[order], item[order]
        size, slack = self.sizes[item], self.slack[item]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (start[1:] - start[:-1] > size[1:])
        at = np.flatnonzero(fresh)
        last = np.append(at[1:], len(start)) - 1
        low, high = np.maximum(0, start[at] - slack[at]), np.minimum(len(words), start[last] + size[at] + slack[at])
        item = item[at]
        rich = np.zeros(len(at), bool)
        upto = np.concatenate([[0], np.cumsum(high - low)])
        for a, b in slices(upto, WINDOW_WORDS):
            n = high[a:b] - low[a:b]
            place = np.repeat(low[a:b] - (upto[a:b] - upto[a]), n) + np.arange(n.sum())
            held = self.members.find(_member(words[place], np.repeat(item[a:b], n))) >= 0
            rich[a:b] = per_row(held, upto[a : b + 1] - upto[a]) >= (self.sizes - self.slack)[item[a:b]]
        return item[rich], low[rich], high[rich]

    def _verified(self, words: np.ndarray, bounds: np.ndarray, start: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Candidates (item would begin at ``start``) by exact edit distance, within each row that a window touches."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        windows = self._windows(words, start, item) if len(start) else ()
        for k, low, high in zip(*(x.tolist() for x in windows), strict=True):
            mine, slack = self.words[k].tolist(), int(self.slack[k])
            for r in range(int(np.searchsorted(bounds, low, "right")) - 1, int(np.searchsorted(bounds, high, "left"))):
                a, b = max(low, int(bounds[r])), min(high, int(bounds[r + 1]))
                if b - a >= len(mine) - slack and (got := nearest(mine, words[a:b].tolist(), slack)):
                    found = (got[0], a - int(bounds[r]) + got[1], a - int(bounds[r]) + got[2])
                    best[r, k] = min(best.get((r, k), found), found)
        return [(r, i, *found) for (r, i), found in best.items()]


def item_blocks(benchmark: DataFrame, text: str = "text", most: int = BLOCK_WORDS) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, an item's words never split; items without words are left out."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty(text)).toLocalIterator()
    for item_id, body in rows:
        data = np.frombuffer(body.encode(), np.uint8)
        words, _ = word_hashes(data, np.array([0, len(data)]))
        if len(words):
            held.append((item_id, words))
            size += len(words)
        if size >= most:
            yield Index.of(held)
            held, size = [], 0
    if held:
        yield Index.of(held)


HITS = "item_id long, edits long, similarity double, first_word long, end_word long"


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document and benchmark item that stands in it with similarity 0.8 or more: ``keep`` columns and HITS.

    ``edits``: the least number of words to insert, delete or replace between the item and a run of the document's words;
    ``first_word`` and ``end_word`` bound that run. Words are compared with A-Z folded. One map over the scan for each block of
    items; nothing is shuffled. Null and blank texts hold nothing; null item ids are carried; equal items are all reported;
    an item of fewer than MIN_WORDS words allows no edit and is found word for word, one without words is left out. Columns beyond ``keep`` are ignored; repeated rows repeat their hits.
    """
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    read = docs.select(*[F.col(c) for c in keep], text_or_empty(text))
    out = None
    for index in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                for low, _, data, offsets in texts_of(batch):
                    found = items.search(*word_hashes(data, offsets))
                    rows = pa.array([low + f[0] for f in found], pa.int64())
                    n = [len(items.words[f[1]]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).take(rows) for c in keep]
                        + [pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()),
                           pa.array([1 - f[2] / m for f, m in zip(found, n, strict=True)], pa.float64()),
                           pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                        names=[*keep, "item_id", "edits", "similarity", "first_word", "end_word"],
                    )

        hits = read.mapInArrow(run, f"{carried}, {HITS}")
        out = hits if out is None else out.unionByName(hits)
    return docs.sparkSession.createDataFrame([], f"{carried}, {HITS}") if out is None else out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the same columns: a map over the scan for each block of items."""
    for index in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in batches:
                bad = {low + f[0] for low, _, data, offsets in texts_of(batch, text) for f in items.search(*word_hashes(data, offsets))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

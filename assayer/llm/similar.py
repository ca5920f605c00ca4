"""Near-duplicates of the pipeline stage: SimHash through pivot tables, for texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more.

Fingerprints of five-word shingles meet as in ``simhash``: under keys of intact bits the pivot tables discard, and what differs in at
most three bits is joined. No set of intact bits reaches the ten bits at which sets of similarity 0.8 differ, so sets that share a
MinHash band are joined as well. What is joined makes coarse groups. Within a group each fingerprint has a row of precomputed Hamming
distances to reference fingerprints. Pairs whose rows differ by more than the radius in any coordinate are discarded, those beyond the
radius too, and survivors are verified by the exact Jaccard similarity of their sets; what is verified makes the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.common import mixed, text_or_empty, texts_of, written
from assayer.llm.components import components
from assayer.llm.decontaminate import word_hashes
from assayer.llm.simhash import links as fingerprint_links
from assayer.llm.simhash import pivot_table

SHINGLE = 5  # words; a shorter text is one shingle
SIMILARITY = 0.8  # Jaccard
RADIUS = 24  # bits of 64; at similarity 0.8 fingerprints differ by 10 on average, with a deviation of 3
BANDS, ROWS = 16, 5  # a pair of similarity 0.8 misses all bands with probability 0.0017
CELL = 1 << 18  # shingles that one task compares with as many others at once
SEEDS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, from the hashes of its words."""
    if not len(words):
        return np.empty(0, np.uint64)
    k = min(SHINGLE, len(words))
    total = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        total = mixed(total + words[i : len(words) - k + 1 + i])
    return np.unique(total)


def digest(found: np.ndarray) -> tuple[int, int, list[int]]:
    """(node, fingerprint, band keys) of a set of shingles; node: a hash of the whole set."""
    if not len(found):
        return 0, 0, []
    with np.errstate(over="ignore"):
        node = mixed(mixed(found ^ np.uint64(0x51ED270B9F3A8C4D)).sum(keepdims=True) + np.uint64(len(found)))[0]
        bits = np.zeros(64, np.int64)
        least = np.full(len(SEEDS), np.iinfo(np.uint64).max)
        for low in range(0, len(found), 1 << 14):  # a long text goes by parts
            part = found[low : low + (1 << 14)]
            bits += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            for s, seed in enumerate(SEEDS):
                x = (part ^ seed) * np.uint64(0xD6E8FEB86659FD93)
                least[s] = min(least[s], ((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)).min())
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in least.reshape(BANDS, ROWS).T:
            keys = mixed(keys + row)
    fp = np.packbits(2 * bits > len(found), bitorder="little").view(np.int64)[0]
    return int(node.view(np.int64)), int(fp), keys.view(np.int64).tolist()


def _rounds(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows of a batch and their sets, by rounds of array work, so that the sets of one round only are held at once."""
    for low, high, data, offsets in texts_of(batch):
        words, bounds = word_hashes(data, offsets)
        yield batch.slice(low, high - low), [shingles(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def linked(fps: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first row of its component: every row is held against all that are not reached yet.

    Rows lie in the order of their first pivot distance, so that a row meets only the stretch within the radius; the greatest
    difference of the other pivots' coordinates discards next, then the fingerprints' own distance, then the sizes.
    """
    table = pivot_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    sizes = np.array([len(s) for s in sets])
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    mine = np.zeros(len(flat), bool)
    root = np.full(len(sets), -1)
    rest = order  # not reached yet, by first pivot distance
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first] = first
        rest = rest[rest != first]
        reached = [first]
        while reached and len(rest):
            x = reached.pop()
            low, high = np.searchsorted(table[rest, 0], [table[x, 0] - RADIUS, table[x, 0] + RADIUS + 1])
            at = np.arange(low, high)
            at = at[np.abs(table[rest[at]] - table[x]).max(axis=1, initial=0) <= RADIUS]
            at = at[np.bitwise_count(fps[rest[at]] ^ fps[x]) <= RADIUS]
            n = sizes[rest[at]]
            at = at[np.minimum(n, sizes[x]) >= SIMILARITY * np.maximum(n, sizes[x]) - 1e-9]
            if not len(at):
                continue
            own = ids[ends[x] - sizes[x] : ends[x]]
            mine[own] = True
            n = sizes[rest[at]]
            upto = np.cumsum(n) - n
            place = np.repeat(ends[rest[at]] - n - upto, n) + np.arange(n.sum())
            both = np.add.reduceat(mine[ids[place]].astype(np.int64), upto)
            mine[own] = False
            at = at[both >= SIMILARITY * (n + sizes[x] - both) - 1e-9]
            root[rest[at]] = first
            reached += rest[at].tolist()
            rest = np.delete(rest, at)
    return root


def _verified(table: pa.Table) -> pa.Table:
    """Edges (a, b) that connect what is linked within a cell."""
    node, first = np.unique(table.column("node").to_numpy(), return_index=True)
    body = table.column("shingles")
    fps = table.column("fp").to_numpy()[first].view(np.uint64)
    root = linked(fps, [np.frombuffer(body[int(i)].as_py(), np.uint64) for i in first])
    apart = root != np.arange(len(root))
    return pa.table({"a": pa.array(node[apart]), "b": pa.array(node[root[apart]])})


def links(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): edges that connect the sets of ``rows`` (node, component, fp, size, shingles) with similarity SIMILARITY or more.

    A group over CELL shingles is cut in parts and each two parts meet in a cell, so no pair of a group is left out.
    """
    parts = groups.select("component", F.ceil(F.col("weight") / CELL).cast("int").alias("parts"))
    told = rows.join(parts, "component").withColumn("p", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    mates = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("parts") - 1)), lambda q: F.struct(F.least("p", q).alias("i"), F.greatest("p", q).alias("j")))
    # two parts of one group meet once; what lies in one part meets in all cells of the part, so a cell (i, i) is not needed
    cells = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(F.filter(mates, lambda m: m["i"] < m["j"]))
    dealt = told.select("node", "component", "fp", "shingles", F.explode(cells).alias("cell"))
    return dealt.groupBy("component", "cell.i", "cell.j").applyInArrow(_verified, "a long, b long")


def meetings(nodes: DataFrame) -> DataFrame:
    """(a, b): edges that connect the sets of ``nodes`` (node, fp, bands) which may be similar.

    Sets meet if pivot tables link their fingerprints, which equal ones always are, or if they share a band key. A hub stands for
    all sets of one fingerprint and for all of one key, so copies cost one edge each.
    """
    hubs = written(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "hubs")
    equal = nodes.join(hubs, "fp").select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b")
    left, right = (hubs.select(F.col("fp").alias(k), F.col("hub").alias(f"{k}_hub")) for k in "ab")
    near = fingerprint_links(hubs.select("fp")).join(left, "a").join(right, "b").select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head")
    banded = keyed.join(heads, "key").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return equal.union(near).union(banded)


def one_of_similar(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``docs`` less all but one of each component of similar texts, with the same columns.

    Words are compared with A-Z folded; null and blank texts are one component. The row that stays is the one with the
    smallest doc_id, nulls last; among rows of one doc_id two hashes of the whole row decide, and of wholly equal rows one stays.
    """
    names = docs.columns
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])  # the stage's own columns clash with none of the input
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", text))
    cells = [x for c in docs.columns for x in (F.col(c).cast("string"), F.col(c).isNull())]
    tied = docs.withColumns({"__a": F.xxhash64(*cells), "__b": F.xxhash64(F.lit(1), *cells)})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in (r for batch in batches for r in _rounds(batch)):
            node, fp, bands, size = zip(*[(*digest(s), len(s)) for s in sets], strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "__a", "__b")), pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(size, pa.int64())],
                names=["doc_id", "__a", "__b", "node", "fp", "bands", "size"],
            )

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in (r for batch in batches for r in _rounds(batch)):
            body = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "component", "fp")), body], names=["node", "component", "fp", "shingles"])

    keys = tied.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text), "__a", "__b")
    marked = keys.mapInArrow(digests, "doc_id long, __a long, __b long, node long, fp long, bands array<long>, size long")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("__a"), F.col("__b"))
    nodes = written(written(marked, "digests").groupBy("node").agg(
        F.min(order).alias("first"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size"),
    ), "nodes")
    coarse = written(components(nodes.select("node"), meetings(nodes)), "coarse")
    sized = coarse.join(nodes.select("node", "size"), "node").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    groups = written(sized.where("n > 1"), "groups")
    want = nodes.join(coarse.join(groups, "component"), "node").select("node", "component", "fp", "first.__a", "first.__b")
    texts = tied.select(text_or_empty(text), "__a", "__b").join(want, ["__a", "__b"]).select("node", "component", "fp", "text")
    rows = written(texts.mapInArrow(bodies, "node long, component long, fp long, shingles binary"), "shingles")
    found = components(nodes.select("node"), links(rows, groups))
    kept = nodes.join(found, "node").groupBy("component").agg(F.min("first").alias("first")).select("first.__a", "first.__b")
    alone = Window.partitionBy("__a", "__b").orderBy("__a")  # only equal rows share a partition
    return tied.join(kept, ["__a", "__b"], "left_semi").withColumn("__n", F.row_number().over(alone)).where("__n = 1").select(*docs.columns).toDF(*names)

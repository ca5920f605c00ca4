"""SimHash near-duplicates through pivot distance tables.

Fingerprints that differ in at most three of 64 bits are linked. Candidates meet under keys of intact bits: of five blocks at least
two are equal, so ten keys reach every link. Within a key, each fingerprint has a row of precomputed Hamming distances to
reference fingerprints; a pair whose rows differ by more than three in any coordinate is discarded, and survivors are verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.common import WORD, partitions, text_or_empty, written
from assayer.llm.components import components

SHINGLE = 3  # words
DISTANCE = 3  # bits
SEED = 42
BLOCKS = (13, 13, 13, 13, 12)  # bits; of five, two stay intact
TABLES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - DISTANCE))
PIVOTS = np.random.default_rng(64).integers(0, 1 << 63, 24, dtype=np.uint64) * np.uint64(2) + np.random.default_rng(65).integers(0, 2, 24, dtype=np.uint64)
CROWD = 1024  # fingerprints under one key; larger keys are split by more intact bits
_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprint(text: str) -> int:
    """Bits that are set in over half of the shingles' hashes; repeated shingles count as often."""
    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(64, np.int64)
    for low in range(0, n, 1 << 16):  # a long text goes by parts
        part = words[low : low + (1 << 16) + SHINGLE - 1]
        m = max(1, len(part) - SHINGLE + 1)
        hashes = np.fromiter((xxhash.xxh64_intdigest(" ".join(part[i : i + SHINGLE]), SEED) for i in range(m)), np.uint64, m)
        total += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and fp, the fingerprint as a signed long; a null or blank text has 0. A map over the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(marks.view(np.int64))], names=[*keep, "fp"])

    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    return docs.select(*[F.col(c) for c in keep], text_or_empty(text)).mapInArrow(run, f"{carried}, fp long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint to every pivot, one row each."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def forest(group: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what is linked within groups: (fingerprint, one of its component), a row at most each.

    Rows are ordered by group and first pivot distance. A sweep compares every row with the o-th row behind it, for o = 1, 2,
    ... until no pair of one group is within reach of the first pivot; the other pivots discard, and what is left is verified.
    """
    table = pivot_table(fp)
    order = np.lexsort((table[:, 0], group))
    group, fp, table = group[order], fp[order], table[order]
    root = np.arange(len(fp))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    live = np.arange(len(fp))
    offset = 1
    while len(live := live[live + offset < len(fp)]):
        live = live[(group[live] == group[live + offset]) & (table[live + offset, 0] - table[live, 0] <= DISTANCE)]
        left, right = live, live + offset
        for k in range(1, table.shape[1]):
            near = np.abs(table[left, k] - table[right, k]) <= DISTANCE
            left, right = left[near], right[near]
        linked = np.bitwise_count(fp[left] ^ fp[right]) <= DISTANCE
        left, right = left[linked], right[linked]
        if len(left):
            while (root[root] != root).any():
                root = root[root]
            apart = root[left] != root[right]  # the others are connected already
            left, right = left[apart], right[apart]
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        offset += 1
    return [(int(fp[i]), int(fp[r])) for i in range(len(fp)) if (r := find(i)) != i]


def _bits(low: int, n: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << n) - 1))


def _keys() -> Column:
    """Ten keys of (table, two blocks)."""
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    return F.array(*[
        F.struct(F.lit(t).alias("t"), sum((F.shiftleft(_bits(at[b], BLOCKS[b]), 13 * i) for i, b in enumerate(kept)), F.lit(0).cast("long")).alias("key"), F.lit(-1).alias("part"), F.lit(0).cast("long").alias("sub"))
        for t, kept in enumerate(TABLES)
    ])


def _parts() -> Column:
    """For each table, the bits outside its blocks in four parts, one of which is intact in any linked pair."""
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    out = F.array().cast("array<struct<part:int,sub:bigint>>")
    for t, kept in enumerate(TABLES):
        rest = [at[b] + i for b in range(len(BLOCKS)) if b not in kept for i in range(BLOCKS[b])]
        cuts = [rest[k * len(rest) // (DISTANCE + 1) : (k + 1) * len(rest) // (DISTANCE + 1)] for k in range(DISTANCE + 1)]
        masks = [sum(1 << b for b in cut) for cut in cuts]
        parts = F.array(*[
            F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("sub")) for k, m in enumerate(masks)
        ])
        out = F.when(F.col("t") == t, parts).otherwise(out)
    return out


def links(fps: DataFrame) -> DataFrame:
    """(a, b): edges between distinct fingerprints (fp) that connect all that is linked, at most one for each fingerprint and key.

    A key with over CROWD fingerprints is split fourfold by further bits: of four parts of the others one is intact too. What
    then shares a key differs in under 30 bits; it is compared by sweeps in numpy, never as rows of pairs.
    """
    spark = fps.sparkSession
    keyed = fps.select("fp", F.explode(_keys()).alias("k")).select("fp", "k.*")
    crowds = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("t", "key", F.lit(True).alias("crowd"))
    marked = keyed.join(crowds, ["t", "key"], "left")
    whole = F.array(F.struct(F.col("part"), F.col("sub")))
    dealt = marked.select("fp", "t", "key", F.explode(F.when(F.col("crowd"), _parts()).otherwise(whole)).alias("p")).select(
        "fp", F.xxhash64("t", "key", "p.part", "p.sub").alias("mark"),
    ).withColumn("bucket", F.pmod("mark", F.lit(4 * partitions(spark))))

    def sweep(table: pa.Table) -> pa.Table:
        group = table.column("mark").to_numpy()
        fp = table.column("fp").to_numpy().view(np.uint64)
        _, back, n = np.unique(group, return_inverse=True, return_counts=True)
        shared = n[back] > 1
        found = forest(group[shared], fp[shared])
        a = np.array([x for x, _ in found], np.uint64).view(np.int64)
        b = np.array([x for _, x in found], np.uint64).view(np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return dealt.groupBy("bucket").applyInArrow(sweep, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    ``fingerprint``: 16 hex digits. ``component_id``: the smallest doc_id that links reach, itself included; a null doc_id is
    never the smallest, and a component of such rows alone has null. Equal fingerprints are one node, so any number of copies
    costs one. Null and blank texts have the fingerprint zero and are linked like any other. Other columns are ignored, also
    such with names of the result; repeated rows give repeated results.
    """
    marked = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    groups = components(nodes.select(F.col("fp").alias("node")), links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    joined = written(nodes.join(groups, "fp"), "groups")
    named = joined.join(joined.groupBy("component").agg(F.min("first").alias("component_id")), "component").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents of ``docs`` less all but one of each near-duplicate group, with the same columns.

    The row that stays is the one with the smallest doc_id, nulls last; among rows of one doc_id two hashes of the whole row
    decide, and of wholly equal rows one stays. Minima combine before the shuffle, and texts are dealt once, by these hashes.
    """
    cells = [x for c in docs.columns for x in (F.col(c).cast("string"), F.col(c).isNull())]
    tied = docs.withColumns({"__a": F.xxhash64(*cells), "__b": F.xxhash64(F.lit(1), *cells)})
    keys = tied.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), "__a", "__b")
    marked = written(fingerprints(keys, keep=("doc_id", "__a", "__b")), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id"), F.col("__a"), F.col("__b"))
    nodes = written(marked.groupBy("fp").agg(F.min(order).alias("first")), "nodes")
    groups = components(nodes.select(F.col("fp").alias("node")), links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    kept = nodes.join(groups, "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.__a", "first.__b")
    found = tied.join(kept, ["__a", "__b"], "left_semi")
    first = F.row_number().over(Window.partitionBy("__a", "__b").orderBy("__a"))  # only equal rows share a partition
    return found.withColumn("__n", first).where("__n = 1").select(*docs.columns)

"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length for each source. Whole passes over a source come first; of what its budget still lacks,
every length gives its even share, and a bounded-knapsack dynamic programme over the remaining counts fills the rest as exactly
as sums of lengths can. Which documents of a length are taken is decided by seeded hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assayer.llm.common import WORD, partitions, text_or_empty, written

WEIGHTS = (5, 2, 1)  # by a source's rank, repeating
SHARE = 1.5  # of all sizes
MOST = 2  # times that a document, and so a source, is taken at most
SEED = 20250117
SLICES = 256  # hash slices of a length's documents: only one of them is ever ranked
WINDOW = 1 << 16  # words below which the dynamic programme fits the rest of a budget



def _key():
    """A source as a join key that orders by code point with the null source last."""
    return F.when(F.col("source").isNull(), F.lit("w")).otherwise(F.concat(F.lit("v"), F.col("source")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, weight, target) for sizes by key.

    Ranks come from range partitions and their counts, so sources are never gathered in one task. Budgets are shared by weight;
    a source whose share exceeds ``most`` times its size is capped and the excess reshared, one aggregate a round, until none is.
    """
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    dealt = totals.repartitionByRange(partitions(sizes.sparkSession), "key").withColumn("part", F.spark_partition_id())
    totals = written(dealt, "sources")
    inside = Window.partitionBy("part").orderBy("key")
    counts = {r["part"]: r["n"] for r in totals.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, rows = 0, []
    for part in sorted(counts):
        rows.append((part, before))
        before += counts[part]
    offsets = sizes.sparkSession.createDataFrame(rows, "part int, before long")
    turn = (F.col("before") + F.row_number().over(inside) - 1) % len(weights)
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(float(w))).otherwise(weight)
    ranked = totals.join(F.broadcast(offsets), "part").withColumn("weight", weight).drop("part", "before")
    ranked = written(ranked, "weights")

    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, cap = 0.0, F.col("source_size") * float(most)
    capped = F.lit(False)
    budget = min(share, most) * total
    while True:
        free, used = ranked.agg(
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(F.when(capped, cap)), F.lit(0.0)),
        ).first()
        new = (budget - used) / free if free else level
        if not free or new <= level:
            break
        level = new
        capped = cap <= F.col("weight") * F.lit(level)
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap))


def fit(length: np.ndarray, count: np.ndarray, budget: float, window: int = WINDOW) -> np.ndarray:
    """How many items of each length to take so that their sum comes as near ``budget`` as it can without going far over.

    Even shares first; then, longest first, as many as leave a rest within the window; then a bounded knapsack: counts are
    split into binary bundles and a bit set of reachable sums, kept for each bundle, is walked back from the nearest sum.
    """
    length, count = length.astype(object), count.astype(object)  # exact at any size
    goal = int(round(budget))
    total = int((length * count).sum())
    if goal <= 0 or total == 0:
        return np.zeros(len(length), np.int64)
    if goal >= total:
        return count.astype(np.int64)
    taken = count * goal // total
    rest = goal - int((length * taken).sum())
    for i in np.argsort(-length.astype(np.int64), kind="stable"):
        if length[i] and rest > window:
            more = min(count[i] - taken[i], (rest - window) // length[i] + 1, rest // length[i])
            taken[i] += more
            rest -= more * length[i]
    slack = int(max(length))
    bundles: list[tuple[int, int]] = []
    for i in range(len(length)):
        left, size = int(min(count[i] - taken[i], (rest + slack) // length[i] if length[i] else 0)), 1
        while left > 0:
            n = min(size, left)
            bundles.append((i, n))
            left, size = left - n, 2 * size
    mask = (1 << (rest + slack + 1)) - 1
    reach, steps, target = 1, [], 1 << rest
    for i, n in bundles:
        steps.append(reach)
        reach |= (reach << n * int(length[i])) & mask
        if reach & target:
            break
    under = (reach & ((target << 1) - 1)).bit_length() - 1
    over = reach >> (rest + 1)
    above = rest + 1 + ((over & -over).bit_length() - 1) if over else None
    best = above if above is not None and above - rest < rest - under else under
    if not (steps and best):
        return taken.astype(np.int64)
    for k in range(len(steps) - 1, -1, -1):
        if not steps[k] >> best & 1:
            i, n = bundles[k]
            taken[i] += n
            best -= n * int(length[i])
    return taken.astype(np.int64)


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, text: str = "text",
    keep: tuple[str, ...] = ("doc_id",), reread: bool = False, tie: str | None = None,
) -> DataFrame:
    """How often each document is taken: ``keep`` columns, key, size, source_size, target, copies, taken.

    A null text has size 0 and is never taken more often than its source's whole passes; a null source is a source of its own and
    comes last. Sources with nothing in them get nothing. Which of several equal documents is taken follows from the hash of
    (doc_id, text, seed) and the column ``tie``, if there is one; rows that are equal in these are interchangeable. Other columns are ignored.

    Shuffles hold numbers and the ``keep`` columns. ``reread``: take sizes from the texts twice instead of writing them down, for
    wide ``keep`` columns. A common length of a hot source is split by hash slices
    and summed before the shuffle: a slice is taken whole or not at all, but for one of them, in which documents are ranked.
    """
    filled = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bits = SLICES.bit_length() - 1
    sized = docs.select(
        *[F.col(c) for c in keep], F.col("source").cast("string").alias("source"), F.regexp_count(filled, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id"), filled, F.lit(seed), *([F.col(tie)] if tie else [])).alias("draw"),
    ).withColumn("key", _key()).withColumn("slice", F.shiftrightunsigned("draw", 64 - bits).cast("int")).drop("source")
    sized = sized if reread else written(sized, "sizes")
    cells = written(sized.groupBy("key", "size", "slice").agg(F.count("*").alias("n")), "cells")
    by_size = cells.groupBy("key", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(by_size.select("key", (F.col("size") * F.col("n")).alias("size")), weights, share, most)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = min(int(target // whole), most) if whole else 0
        group = group.sort_values("size")
        group["passes"] = passes
        group["quota"] = fit(group["size"].to_numpy(), group["n"].to_numpy(), target - passes * whole) if whole and passes < most else 0
        return group[["key", "size", "quota", "passes", "source_size", "target"]]

    # a group is a source's histogram: one row for each length that occurs
    quotas = by_size.join(targets.select("key", "source_size", "target"), "key").groupBy("key").applyInPandas(
        choose, "key string, size long, quota long, passes int, source_size long, target double",
    )
    upto = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ruled = cells.withColumn("upto", F.sum("n").over(upto)).join(quotas, ["key", "size"]).select(
        "key", "size", "slice", "passes", "source_size", "target",
        F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("upto") + F.col("n"))).alias("room"), "n",
    )
    joined = sized.join(ruled, ["key", "size", "slice"])
    sure = joined.where("room = 0 OR room = n").withColumn("extra", (F.col("room") > 0).cast("int"))
    place = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("draw"))
    ranked = joined.where("room > 0 AND room < n").withColumn("extra", (place <= F.col("room")).cast("int"))
    return sure.unionByName(ranked).select(
        *keep, "key", "size", "source_size", "target", (F.col("passes") + F.col("extra")).alias("copies"),
        (F.col("size") * (F.col("passes") + F.col("extra"))).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    All columns enter the draw, so that only wholly equal rows are interchangeable and the partitioning does not show.
    """
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("document")
    tie = F.xxhash64(*[x for c in docs.columns for x in (F.col(c).cast("string"), F.col(c).isNull())]).alias("tie")
    chosen = mix(docs.select("doc_id", "source", "text", whole, tie), keep=("doc_id", "document"), reread=True, tie="tie", **options)
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("copy")
    return chosen.where("copies > 0").select("document", copies).select("document.*")

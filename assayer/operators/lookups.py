"""Semi joins, exclusions, pair lists, collapses, ranks and samples."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.operators.kernels import null_safe_join, numbered, sized_side, value_ranks
from assayer.operators.profile import _top
from assayer.session import materialise


def top_categories(df: DataFrame, column: str, n: int) -> DataFrame:
    """``n`` most frequent values by (count desc, value): a bounded top-k over the counts."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(n)


def keep_top(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent categories; the list has at most ``n`` entries."""
    return df.join(F.broadcast(top_categories(df, column, n).select(column)), column, "left_semi")


def keep_large_groups(df: DataFrame, group: str, min_size: int) -> DataFrame:
    """Rows whose group has at least ``min_size`` members."""
    large = df.groupBy(group).agg(F.count(F.lit(1)).alias("c")).filter((F.col("c") >= min_size) & F.col(group).isNotNull())
    return df.join(sized_side(large.select(group)), group, "left_semi")


def collapse(df: DataFrame, column: str, n: int, other: str = "Other") -> DataFrame:
    """Keep the ``n`` most frequent categories, name the rest ``other``; null stays null."""
    top = F.broadcast(top_categories(df, column, n).select(F.col(column).alias("__kept")))
    return df.join(top, F.col(column) == F.col("__kept"), "left").withColumn(
        column, F.when(F.col("__kept").isNotNull(), F.col("__kept")).when(F.col(column).isNotNull(), other)
    ).drop("__kept")


def column_pairs(spark: SparkSession, columns: Sequence[str], exclude: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """All unordered pairs of a list of columns, minus an exclusion list (in either order)."""
    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, name string")
    left, right = names.toDF("i", "left_column"), names.toDF("j", "right_column")
    pairs = left.join(right, F.col("i") < F.col("j")).select("left_column", "right_column")
    banned = [(a, b) for pair in exclude for a, b in (pair, pair[::-1])]
    if not banned:
        return pairs
    listed = spark.createDataFrame(banned, "left_column string, right_column string")
    return pairs.join(listed, ["left_column", "right_column"], "left_anti")


def key_membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Which side each key occurs on; one shuffle, repeats combine before it."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    place = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left_only").otherwise("right_only")
    return sides.select(key, place.alias("membership"))


def holm(df: DataFrame, p_value: str, family: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Step-down adjusted p-values inside each family of tests (a handful of rows each)."""
    order = Window.partitionBy(*family).orderBy(p_value, *tie_break)
    size = F.count(F.lit(1)).over(Window.partitionBy(*family))
    stepped = df.withColumn("__h", (size - F.row_number().over(order) + 1) * F.col(p_value))
    running = F.max("__h").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("holm_adjusted_p_value", F.least(running, F.lit(1.0))).drop("__h").withColumn(
        "significant_after_holm", F.col("holm_adjusted_p_value") < 0.05
    )


def average_ranks(df: DataFrame, value: str, range_rows: int | None = None) -> DataFrame:
    """(value, n, avg_rank) of every distinct value, ties sharing their mean rank."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.withColumn("key", F.lit(0))
    ranks = value_ranks(keyed, ["key"], **({"range_rows": range_rows} if range_rows else {}))
    return ranks.select("value", "n", "avg_rank")


def first_per_group(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """First row of each group with the group's place in the order of the groups."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered(ranked.filter("__r = 1").drop("__r"), [group])


MARK_DIGITS = 15
MARK_END = 16.0**MARK_DIGITS


def row_mark(identity: Sequence[str], seed: int) -> Column:
    """A number spread evenly over [0, MARK_END): the head of an MD5, which any engine can repeat."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, MARK_DIGITS), 16, 10).cast("long")


def smallest_marks(rows: DataFrame, by: Sequence[str], quotas: DataFrame, mark: str, order: Sequence[str]) -> DataFrame:
    """The ``__quota`` rows of each group with the smallest marks; ``quotas`` has by, ``__n`` (rows) and ``__quota``.

    Marks are even, so rows beyond a cut somewhat above quota / n are dropped before anything is shuffled; a few more than the
    quota are ranked. A group that comes up short, which is very unlikely, widens the cut and the choice is made again.
    """
    quotas = materialise(quotas)
    placed = null_safe_join(rows, sized_side(quotas), by)
    slack = 6.0
    while True:
        cut = (F.col("__quota") + slack * F.sqrt(F.col("__quota")) + slack * slack) / F.col("__n") * MARK_END
        near = materialise(placed.filter(F.col(mark) <= cut))
        got = near.groupBy(*by).agg(F.count(F.lit(1)).alias("__got"))
        short = null_safe_join(quotas, got, by, "left").filter(F.coalesce("__got", F.lit(0)) < F.least("__quota", "__n"))
        if not short.limit(1).count():
            break
        slack *= 4
    ranked = near.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(mark, *order)))
    return ranked.filter(F.col("__r") <= F.col("__quota")).drop("__r", "__n", "__quota")


def sample_rows(
    df: DataFrame, max_rows: int, identity: Sequence[str], stratify_by: str | None = None, seed: int = 42
) -> DataFrame:
    """Reproducible sample: rows with the smallest mark, proportional per stratum (at least one each).

    Marks are hashes of ``identity`` and the seed, so partitioning does not matter.
    """
    stratum = F.col(stratify_by) if stratify_by else F.lit(0)
    rows = df.withColumns({"__s": stratum, "__h": row_mark(identity, seed)})
    sizes = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.greatest(F.lit(1), F.bround(F.lit(float(max_rows)) * F.col("__n") / F.col("__total"), 0).cast("long"))
    quotas = sizes.withColumn("__total", total).select(
        "__s", "__n", F.when(F.col("__total") <= max_rows, F.col("__n")).otherwise(share).alias("__quota")
    )
    return smallest_marks(rows, ["__s"], quotas, "__h", identity).select(*df.columns)

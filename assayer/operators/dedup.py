"""Exact and logical deduplication.

Both are aggregations rather than windows: copies combine before the shuffle,
so a group holding a third of the table reaches its reducer as a few rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.numbers import present_count


def count_copies(df: DataFrame, name: str = "copies") -> DataFrame:
    """One row per distinct row with its number of copies."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(name))


def drop_exact(df: DataFrame, flag: str = "was_exact_duplicate") -> DataFrame:
    """Keep one of each set of identical rows and mark those that had copies."""
    counted = count_copies(df, "__copies")
    return counted.withColumn(flag, F.col("__copies") > 1).drop("__copies")


def completeness_score(columns: Sequence[str]) -> Column:
    return present_count(*[F.col(c) for c in columns])


def drop_logical(
    df: DataFrame,
    key: str,
    score_columns: Sequence[str],
    latest: str | None = None,
    tie_break: Sequence[str] = (),
    flag: str = "was_logical_duplicate",
    carried: Sequence[str] = (),
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Keep the best row of each key: most complete, then latest, then the tie columns, then a row hash.

    Row position is not defined in a distributed table, so the last resort is a
    hash of the row: the same row wins on every run and every partitioning. ``carried`` columns come along but have no say;
    ``totals`` are aggregates over all rows of a key, in place of a column of that name or beside the others.
    """
    totals = totals or {}
    order = [completeness_score(score_columns).alias("o0")]
    if latest:
        order += [F.col(latest).isNotNull().alias("o1"), F.col(latest).alias("o2")]
    order += [F.col(c).alias(f"t{i}") for i, c in enumerate(tie_break)]
    order.append(F.xxhash64(*[c for c in df.columns if c not in carried]).alias("h"))
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.struct(*order)).alias("__best"),
        (F.count(F.lit(1)) > 1).alias(flag),
        *[total.alias(f"__total_{name}") for name, total in totals.items()],
    )
    kept = [F.col(key) if c == key else F.col("__best")[c].alias(c) for c in df.columns if c not in totals]
    return best.select(*kept, flag, *[F.col(f"__total_{name}").alias(name) for name in totals])


def duplicate_summary(df: DataFrame, keys: Sequence[Sequence[str]], null_keys: bool = True) -> DataFrame:
    """Rows in repeated keys, number of repeated keys and their share, one row per key set.

    ``null_keys`` counts a null as a key value; without it rows with a null key are left out. All key sets are grouping sets of one
    scan; the grouping id tells their groups apart, also a null that was there from one of a column that a set leaves out.
    """
    columns = sorted({c for key in keys for c in key})
    sets = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in key): sorted(set(key)) for key in keys}
    groups = df.groupingSets([[F.col(c) for c in own] for own in sets.values()], *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("c"), F.grouping_id().alias("id"))
    blank = F.lit(False)
    for number, own in sets.items() if not null_keys else ():
        blank = F.when(F.col("id") == number, reduce(lambda a, b: a | b, [F.col(c).isNull() for c in own])).otherwise(blank)
    repeated = (F.col("c") > 1) & ~blank
    found = groups.groupBy("id").agg(
        F.sum("c").alias("total"), F.sum(F.when(repeated, F.col("c"))).alias("duplicate_rows"), F.count_if(repeated).alias("duplicate_keys"))
    listed = df.sparkSession.createDataFrame(
        [(sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in key), ", ".join(key)) for key in keys], "id long, key_columns string")
    rows, zero = F.coalesce("duplicate_rows", F.lit(0)), F.lit(0).cast("long")
    return listed.join(F.broadcast(found), "id", "left").select(
        "key_columns", rows.alias("duplicate_rows"), F.coalesce("duplicate_keys", zero).alias("duplicate_keys"),
        F.coalesce(F.round(rows * F.lit(100.0) / F.col("total"), 4), F.lit(0.0)).alias("duplicate_pct"),
    )


def exact_duplicate_count(df: DataFrame) -> DataFrame:
    """Copies beyond the first, over all columns."""
    return count_copies(df).agg(
        F.sum("copies").alias("rows"),
        F.sum(F.col("copies") - 1).alias("duplicate_rows"),
        F.round(F.sum(F.col("copies") - 1) * F.lit(100.0) / F.sum("copies"), 4).alias("duplicate_pct"),
    )


def variation_in_groups(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Share of repeated keys inside which each column takes more than one value.

    Works on (key, column, value) counts, so neither a hot key nor a long list of
    values sits in one buffer.
    """
    from assayer.operators.kernels import long_form

    levels = (
        long_form(df, columns, [key]).groupBy(key, "column", "value").agg(F.count(F.lit(1)).alias("c"))
        .groupBy(key, "column").agg(F.sum("c").alias("copies"), F.count("value").alias("levels"))
        .filter("copies > 1")
    )
    return levels.groupBy("column").agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("levels") > 1).alias("varying_groups"),
        F.round(F.count_if(F.col("levels") > 1) * F.lit(100.0) / F.count(F.lit(1)), 4).alias("variation_pct"),
    )

"""Stored sketches: distinct counts and quantiles that are written per day or partition and merged later.

A table of sketches has one row per group and a few kilobytes per column, however many rows the group has. New days are appended;
a profile over any choice of days merges their sketches and reads no row of the table again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.numbers import finite
from assayer.operators.profile import wide_to_rows

DISTINCT_BITS = 14  # logarithm of the registers of a distinct count
DISTINCT_ERROR = 3 * 1.04 / 2 ** (DISTINCT_BITS / 2)  # relative, three standard errors: 2.4 %
QUANTILE_SIZE = 800  # values a level of a quantile sketch holds
QUANTILE_ERROR = 0.005  # of the rank, as a share of all values


def _hashable(df: DataFrame, column: str) -> Column:
    whole = isinstance(df.schema[column].dataType, (T.StringType, T.IntegerType, T.LongType))
    return F.col(column) if whole else F.col(column).cast("string")


def sketches(df: DataFrame, by: Sequence[str], columns: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """One row per group of ``by``: ``rows`` and, for each column c, ``n|c`` (values that are not null) and ``d|c`` (distinct-count
    sketch); for each of ``numbers`` also ``q|c`` (quantile sketch), ``lo|c`` and ``hi|c`` of its finite values.

    Null keys form a group of their own. Sketches of all tasks combine before the shuffle.
    """
    every = list(dict.fromkeys([*columns, *numbers]))
    made = [F.count(F.lit(1)).alias("rows")]
    for c in every:
        value = finite(F.col(c)) if c in numbers else F.col(c)
        made.append(F.count(value).alias(f"n|{c}"))
        made.append(F.hll_sketch_agg(value.cast("string") if c in numbers else _hashable(df, c), DISTINCT_BITS).alias(f"d|{c}"))
        if c in numbers:
            number = value.cast("double")
            made += [F.kll_sketch_agg_double(number, QUANTILE_SIZE).alias(f"q|{c}"), F.min(number).alias(f"lo|{c}"), F.max(number).alias(f"hi|{c}")]
    return df.groupBy(*by).agg(*made)


def merge_sketches(stored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same table for coarser groups, from stored sketches alone."""
    made = [F.sum("rows").alias("rows")]
    for name in stored.columns:
        kind, _, column = name.partition("|")
        if column:
            merge = {"n": F.sum, "d": F.hll_union_agg, "q": F.kll_merge_agg_double, "lo": F.min, "hi": F.max}[kind]
            made.append(merge(F.col(f"`{name}`")).alias(name))
    return stored.groupBy(*by).agg(*made)


def sketch_profile(stored: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """One row per column over all stored groups: values, nulls, estimated distinct values, extremes and quantiles.

    Distinct counts are within DISTINCT_ERROR, ranks of quantiles within QUANTILE_ERROR. Columns without a quantile sketch and
    columns without values have null quantiles; a table without rows gives counts of 0.
    """
    merged = merge_sketches(stored)
    names = [c[2:] for c in stored.columns if c.startswith("n|")]
    none = F.lit(None).cast("double")

    def measures(c: str) -> dict[str, Column]:
        held, count = f"q|{c}" in stored.columns, F.coalesce(F.first(f"n|{c}"), F.lit(0))
        found = {"non_null_count": count, "distinct_estimate": F.when(count > 0, F.hll_sketch_estimate(F.first(f"d|{c}"))).otherwise(0)}
        found["min"], found["max"] = (F.first(f"lo|{c}"), F.first(f"hi|{c}")) if held else (none, none)
        for q in quantiles:
            found[f"p{q * 100:g}"] = F.when(count > 0, F.kll_sketch_get_quantile_double(F.first(f"q|{c}"), F.lit(q))) if held else none
        return found

    rows = wide_to_rows(merged, {c: measures(c) for c in names}, {"rows": F.coalesce(F.first("rows"), F.lit(0))})
    return rows.withColumn("null_count", F.col("rows") - F.col("non_null_count")).drop("rows")

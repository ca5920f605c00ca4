"""Numbers behind the plots; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.numbers import finite
from assayer.operators.kernels import exact_quantiles, null_safe_join, numbered, sized_side


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width bins between the minimum and maximum; the maximum falls in the last bin."""
    df = df.select(finite(F.col(value)).alias(value))
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    low, high = ends.select("lo").scalar(), ends.select("hi").scalar()
    raw = F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1
    binned = df.filter(F.col(value).isNotNull()).select(value).withColumns({"lo": low, "hi": high}).select(
        "lo", "hi", F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), raw)).otherwise(F.lit(1)).cast("long").alias("bin")
    )
    width = (F.col("hi") - F.col("lo"))
    return binned.groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", "n", (F.col("lo") + (F.col("bin") - 1) * width / bins).alias("bin_start"), (F.col("lo") + F.col("bin") * width / bins).alias("bin_end")
    )


def boxplot(df: DataFrame, value: str, group: str | None = None, overall: str = "all") -> DataFrame:
    """Quartiles, whiskers and outlier counts over everything and per category."""
    rows = df.withColumn(value, finite(F.col(value))).filter(F.col(value).isNotNull())
    name = group or "group"
    labels: list[Column] = [F.lit(overall)] + ([F.col(group)] if group else [])
    spread = rows.select(F.explode(F.array_compact(F.array(*labels))).alias(name), F.col(value).cast("double").alias("v"))
    quartiles = exact_quantiles(spread, ["v"], {"q1": 0.25, "median": 0.5, "q3": 0.75}, [name]).drop("column", "lowest", "highest", "n")
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    placed = null_safe_join(spread, sized_side(quartiles), [name])
    return placed.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col("v") >= low, F.col("v"))).alias("whisker_low"), F.max(F.when(F.col("v") <= high, F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < low) | (F.col("v") > high)).alias("outliers"),
    )


def ci_bars(intervals: DataFrame, keys: tuple[str, ...] = ("column",)) -> DataFrame:
    """Estimate with its distances to the bounds, floored at zero, and its place in the chart."""
    return numbered(intervals, ["estimate", *keys]).select(
        "rank", *keys, "estimate",
        F.greatest(F.lit(0.0), F.col("estimate") - F.col("ci_lower")).alias("distance_below"),
        F.greatest(F.lit(0.0), F.col("ci_upper") - F.col("estimate")).alias("distance_above"),
    )

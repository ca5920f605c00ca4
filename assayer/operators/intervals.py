"""Confidence intervals and the eligibility rules that pick the columns for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import pvalues as PV
from assayer.functions.numbers import finite
from assayer.operators.columns import column_groups
from assayer.operators.kernels import frequencies
from assayer.operators.profile import _top, cardinality, null_profile, wide_to_rows
from assayer.spec import MIN_NON_NULL_PCT, MIN_NUMERIC_LEVELS, Spec

Z95 = PV.normal_quantile(0.975)


def mean_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, mean and standard error per column, in one aggregate."""
    rows = wide_to_rows(df, {
        c: {"n_used": F.count(finite(F.col(c))), "estimate": F.avg(finite(F.col(c))), "sd": F.stddev_samp(finite(F.col(c)))} for c in columns
    })
    error = F.when(F.col("n_used") > 1, F.col("sd") / F.sqrt(F.col("n_used")))
    return rows.filter("n_used > 0").select("column", "n_used", "estimate", error.alias("standard_error"))


def mean_intervals(df: DataFrame, columns: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Student t interval of each mean; a single value is its own interval."""
    stats = mean_stats(df, columns)
    critical = PV.t_critical(F.lit(1 - (1 - confidence) / 2), (F.col("n_used") - 1).cast("double"))
    margin = F.when(F.col("n_used") > 1, critical * F.col("standard_error")).otherwise(0.0)
    return stats.select(
        "column", "n_used", "estimate", "standard_error", F.lit(confidence).alias("confidence_level"),
        (F.col("estimate") - margin).alias("ci_lower"), (F.col("estimate") + margin).alias("ci_upper"),
    )


def wilson(df: DataFrame, z: float = Z95) -> DataFrame:
    """Wilson interval from ``successes`` and ``n_used``."""
    n, p, zz = F.col("n_used").cast("double"), F.col("successes") / F.col("n_used"), z * z
    scale = 1 + F.lit(zz) / n
    centre = (p + F.lit(zz) / (2 * n)) / scale
    margin = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(zz) / (4 * n * n)) / scale
    return df.withColumns({
        "estimate": p, "standard_error": F.sqrt(p * (1 - p) / n), "ci_lower": centre - margin, "ci_upper": centre + margin,
    })


def proportion_intervals(df: DataFrame, binary: Sequence[str], categorical: Sequence[str], top_n: int = 8, confidence: float = 0.95) -> DataFrame:
    """Positive share of 0/1 columns, and the share of each (collapsed) category."""
    parts = []
    if binary:
        counts = wide_to_rows(df, {
            c: {"category": F.lit("positive"), "successes": F.count_if(F.col(c).cast("double") > 0), "n_used": F.count(c)} for c in binary
        })
        parts.append(counts)
    if categorical:
        table = frequencies(df, categorical, keep_nulls=False)
        totals = F.broadcast(table.groupBy("column").agg(F.sum("n").alias("n_used"), F.count(F.lit(1)).alias("levels")))
        top = _top(table, ["column"], top_n).select("column", F.col("value").alias("category"), F.col("n").alias("successes"))
        kept = top.groupBy("column").agg(F.sum("successes").alias("kept")).join(totals, "column")
        other = kept.filter("n_used > kept").select("column", F.lit("Other").alias("category"), (F.col("n_used") - F.col("kept")).alias("successes"))
        merged = top.unionByName(other).groupBy("column", "category").agg(F.sum("successes").alias("successes"))
        parts.append(merged.join(totals.filter("levels >= 2"), "column").select("column", "category", "successes", "n_used"))
    united = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return wilson(united.filter("n_used > 0"), PV.normal_quantile(1 - (1 - confidence) / 2))


def candidates(
    df: DataFrame, spec: Spec, outcomes: Sequence[str], groups: Sequence[str], excluded: Sequence[str] = (), top_n: int = 8
) -> DataFrame:
    """Which analyses each column qualifies for, and why not."""
    kinds = column_groups(df, spec)
    names = df.sparkSession.createDataFrame(
        [(c, g, df.schema[c].dataType.simpleString(), c in outcomes, c in groups, c in excluded) for c, g in kinds.items()],
        "column string, semantic_group string, dtype string, outcome boolean, grouping boolean, model_excluded boolean",
    )
    base = names.join(F.broadcast(null_profile(df).select("column", "non_null_count", "null_pct")), "column").join(
        F.broadcast(cardinality(df).select("column", F.col("distinct_values").alias("nunique"))), "column"
    ).withColumn("non_null_pct", F.round(F.lit(100.0) - F.col("null_pct"), 4))
    group, full = F.col("semantic_group"), F.col("non_null_pct") >= MIN_NON_NULL_PCT
    binary = group.isin("boolean", "binary_numeric")
    discrete = group.isin("categorical", "binary_numeric", "boolean")
    numeric = (group == "numeric") & full & (F.col("nunique") >= MIN_NUMERIC_LEVELS)
    reasons = F.array_compact(F.array(
        F.when(group.isin("text", "technical"), "technical_or_text_column"),
        F.when(~full, "low_completeness"),
        F.when((group == "numeric") & (F.col("nunique") < MIN_NUMERIC_LEVELS), "low_numeric_variability"),
        F.when(discrete & (F.col("nunique") < 2), "single_level"),
        F.when(F.col("model_excluded"), "excluded_from_modeling"),
    ))
    grouping = F.col("grouping") & discrete & full & (F.col("nunique") >= 2)
    predictor = ~F.col("model_excluded") & (numeric | binary | (discrete & full & (F.col("nunique") >= 2)))
    return base.select(
        "column", "semantic_group", "dtype", "non_null_count", "non_null_pct", "null_pct", "nunique", binary.alias("is_binary_like"),
        numeric.alias("eligible_mean_ci"),
        (binary | ((group == "categorical") & full & F.col("nunique").between(2, max(4 * top_n, 12)))).alias("eligible_proportion_ci"),
        (F.col("outcome") & numeric).alias("eligible_group_outcome"), grouping.alias("eligible_group_var"),
        grouping.alias("eligible_categorical_association"), numeric.alias("eligible_numeric_association"), predictor.alias("eligible_predictor"),
        "model_excluded", F.when(F.size(reasons) > 0, F.array_join(reasons, " | ")).otherwise("eligible").alias("skip_reason"),
    )

"""Table and column profiles.

Per-column counts come from one wide aggregate that is then turned into rows;
per-value statistics come from one frequency shuffle over all columns; order
statistics come from the exact quantile kernel. No profile scans once per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import text as X
from assayer.functions.numbers import finite
from assayer.operators.kernels import exact_medians, exact_quantiles, frequencies, long_form, null_safe_join, sized_side
from assayer.session import materialise
from assayer.spec import NEAR_CONSTANT_PCT, PLACEHOLDER_TOKENS, RARE_SHARE, SHORT_TEXT

QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p95": 0.95, "p99": 0.99}


TIE = 1e-9  # means of rounded values do hit exact halves; this sends them up whatever the summation order


def pct(part: Column, whole: Column) -> Column:
    return F.round(part * F.lit(100.0) / whole, 4)


def mean_pct(column: Column) -> Column:
    return F.round(F.avg(column) * 100 + F.lit(TIE), 4)


def wide_to_rows(df: DataFrame, measures: Mapping[str, Mapping[str, Column]], shared: Mapping[str, Column] | None = None) -> DataFrame:
    """One aggregate over all columns, then one row per column.

    ``measures`` maps column name to {measure: aggregate}; every column must
    offer the same measures with the same types.
    """
    shared = shared or {}
    names = list(measures)
    kinds = list(next(iter(measures.values())))
    aggregates = [a.alias(f"{i}_{k}") for i, n in enumerate(names) for k, a in measures[n].items()]
    wide = df.agg(*aggregates, *[a.alias(s) for s, a in shared.items()])
    rows = F.array(*[
        F.struct(F.lit(n).alias("column"), *[F.col(f"{i}_{k}").alias(k) for k in kinds]) for i, n in enumerate(names)
    ])
    return wide.select(*shared, F.inline(rows))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as null, since both are the same absence."""
    return F.nanvl(F.col(name), F.lit(None)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else F.col(name)


def column_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, rows, non_null: the base of every null profile."""
    names = list(columns or df.columns)
    return wide_to_rows(df, {c: {"non_null": F.count(present(df, c))} for c in names}, {"rows": F.count(F.lit(1))})


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    counts = column_counts(df, columns)
    return counts.select(
        "column",
        (F.col("rows") - F.col("non_null")).alias("null_count"),
        pct(F.col("rows") - F.col("non_null"), F.col("rows")).alias("null_pct"),
        F.col("non_null").alias("non_null_count"),
        pct(F.col("non_null"), F.col("rows")).alias("completeness_pct"),
    ).orderBy(F.desc("null_pct"), F.desc("null_count"), "column")


def is_placeholder(text: Column) -> Column:
    """Placeholder test on an already normalised text."""
    return F.coalesce(X.token_of(text).isin(*PLACEHOLDER_TOKENS), F.lit(False))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalised(df: DataFrame) -> DataFrame:
    """Text columns normalised in a projection of their own, so later expressions can read them repeatedly."""
    return df.withColumns({c: X.normalize_text(F.col(c)) for c in text_columns(df)})


def placeholder_counts(df: DataFrame) -> DataFrame:
    """Placeholder tokens per text column, columns without any left out."""
    texts = text_columns(df)
    flags = normalised(df.select(*texts)).select(*[is_placeholder(F.col(c)).alias(c) for c in texts])
    counts = wide_to_rows(flags, {c: {"placeholders": F.count_if(F.col(c))} for c in texts})
    return counts.filter("placeholders > 0").orderBy(F.desc("placeholders"), "column")


def expanded_nulls(df: DataFrame) -> DataFrame:
    """Null share counting placeholder texts as null."""
    texts = set(text_columns(df))
    flags = normalised(df.withColumns({f"n|{c}": present(df, c).isNull() for c in df.columns})).select(
        *[f"n|{c}" for c in df.columns], *[(F.col(f"n|{c}") | is_placeholder(F.col(c)) if c in texts else F.col(f"n|{c}")).alias(f"e|{c}") for c in df.columns]
    )
    measures = {c: {"nulls": F.count_if(F.col(f"n|{c}")), "expanded": F.count_if(F.col(f"e|{c}"))} for c in df.columns}
    rows = wide_to_rows(flags, measures, {"rows": F.count(F.lit(1))})
    return rows.select("column", pct(F.col("nulls"), F.col("rows")).alias("null_pct"),
                       pct(F.col("expanded"), F.col("rows")).alias("expanded_null_pct"))


def value_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: rows, nulls, distinct values, dominant value, all from one frequency table.

    Ties for the dominant value go to the smallest value, null last.
    """
    table = frequencies(df, list(columns or df.columns)).withColumn("present", F.col("value").isNotNull())
    top = table.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("present"), 0).otherwise(F.col("n"))).alias("nulls"),
        F.count("value").alias("distinct_values"),
        F.count_if(~F.col("present")).alias("null_level"),
        F.max(F.struct("n", "present")).alias("first"),
    )
    # The smallest value among those reaching the top count needs that count first; one row per column.
    tied = table.join(F.broadcast(top.select("column", "first")), "column").filter(F.struct("n", "present") == F.col("first"))
    dominant = tied.groupBy("column").agg(F.min("value").alias("dominant_value"), F.max("n").alias("dominant_count"))
    return top.drop("first").join(F.broadcast(dominant), "column")


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values without and with null as a level; ``approximate`` trades exactness for one pass."""
    names = list(columns or df.columns)
    if approximate:
        rows = wide_to_rows(df, {
            c: {"distinct_values": F.approx_count_distinct(c), "has_null": F.max(F.col(c).isNull().cast("int"))} for c in names
        })
    else:
        rows = frequencies(df, names).groupBy("column").agg(
            F.count("value").alias("distinct_values"), F.max(F.col("value").isNull().cast("int")).alias("has_null")
        )
    return rows.select("column", "distinct_values", (F.col("distinct_values") + F.col("has_null")).alias("distinct_with_null"))


def low_variability(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    summary = value_summary(df, columns)
    share = pct(F.col("dominant_count"), F.col("rows"))
    return summary.select(
        "column",
        (F.col("distinct_values") + F.col("null_level")).alias("distinct_with_null"),
        "distinct_values", "dominant_value", share.alias("dominant_share_pct"),
        (F.col("dominant_count") * 100.0 / F.col("rows") >= NEAR_CONSTANT_PCT).alias("is_near_constant"),
        (F.col("distinct_values") + F.col("null_level") <= 1).alias("is_constant"),
        ((F.col("distinct_values") <= 1) & (F.col("rows") > F.col("nulls"))).alias("is_single_value"),
    ).orderBy(F.desc("is_near_constant"), F.desc("dominant_share_pct"), "column")


def frequency_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts and shares of every value of every column, nulls kept."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    return frequencies(df, columns).select(
        "column", F.col("value").alias("category"), F.col("n").alias("count"), pct(F.col("n"), rows).alias("relative_pct")
    )


def _top(table: DataFrame, keys: Sequence[str], n: int, count: str = "n", value: str = "value") -> DataFrame:
    """First ``n`` values of each key by (count desc, value, nulls last).

    A key may have very many values, so they are first cut down in hash slices
    and the slices' winners are ranked together.
    """
    order = [F.desc(count), F.asc_nulls_last(value)]
    sliced = table.withColumn("__slice", F.pmod(F.xxhash64(value), F.lit(64)))
    first = Window.partitionBy(*keys, "__slice").orderBy(*order)
    short = sliced.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= n).drop("__r", "__slice")
    return short.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)


def top_values(df: DataFrame, columns: Sequence[str], n: int, keep_nulls: bool = False) -> DataFrame:
    """Top-``n`` categories per column with their rank."""
    return _top(frequencies(df, columns, keep_nulls), ["column"], n)


def categorical_profile(df: DataFrame, columns: Sequence[str], preview: int = 5) -> DataFrame:
    table = frequencies(df, columns)
    total = df.agg(F.count(F.lit(1))).scalar()
    summary = table.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.count("value").alias("distinct_values"),
        F.count_if(F.col("n") < F.lit(RARE_SHARE) * total).alias("rare_categories"),
    )
    first = _top(table, ["column"], preview)
    listed = first.groupBy("column").agg(
        F.max_by("value", -F.col("rank")).alias("top_category"),
        F.max("n").alias("top_count"),
        F.array_join(  # at most `preview` entries
            F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("value", F.lit("null")).alias("v")))), lambda x: x["v"]), ", "
        ).alias("preview"),
    )
    return summary.join(F.broadcast(listed), "column").select(
        "column", (F.col("rows") - F.col("null_count")).alias("non_null_count"), "null_count",
        pct(F.col("null_count"), F.col("rows")).alias("null_pct"), "distinct_values", "top_category", "top_count",
        pct(F.col("top_count"), F.col("rows")).alias("top_share_pct"), "rare_categories", "preview",
    ).orderBy(F.desc("distinct_values"), F.desc("top_share_pct"), "column")


def numeric_profile(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """Moments, quantiles, fences, outliers, zeros and distinct values per numeric column."""
    named = columns if isinstance(columns, Mapping) else {c: F.col(c) for c in columns}
    numbers = materialise(df.select(*[finite(c).alias(n) for n, c in named.items()]))  # read by four reductions
    names = list(named)
    quantiles = exact_quantiles(numbers, names, QUANTILES, accuracy=accuracy)
    fenced = quantiles.withColumn("iqr", F.col("p75") - F.col("p25")).withColumns({
        "lower_fence": F.col("p25") - F.lit(1.5) * F.col("iqr"), "upper_fence": F.col("p75") + F.lit(1.5) * F.col("iqr"),
    })
    moments = wide_to_rows(numbers, {
        n: {"non_null_count": F.count(n), "mean": F.avg(n), "std": F.stddev_samp(n),
            "zero_count": F.count_if(F.col(n) == 0),
            "binary": F.coalesce(F.every(F.col(n).isin(0.0, 1.0)), F.lit(False))} for n in names
    }, {"rows": F.count(F.lit(1))})
    # Distinct values and outliers are counted on (column, value, n), not on rows.
    levels = long_form(numbers, names, cast="double").filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("c")
    )
    outside = (F.col("value") < F.col("lower_fence")) | (F.col("value") > F.col("upper_fence"))
    counted = levels.join(F.broadcast(fenced.select("column", "lower_fence", "upper_fence")), "column").groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_values"), F.sum(F.when(outside, F.col("c")).otherwise(0)).alias("outlier_count"),
    )
    joined = moments.join(F.broadcast(fenced.drop("n")), "column", "left").join(F.broadcast(counted), "column", "left")
    n = F.col("non_null_count")
    return joined.select(
        "column", "non_null_count", (F.col("rows") - n).alias("null_count"), pct(F.col("rows") - n, F.col("rows")).alias("null_pct"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), F.col("binary").alias("is_binary_like"), "mean",
        F.when(n == 1, F.lit(0.0)).otherwise(F.col("std")).alias("std"),
        F.col("lowest").alias("min"), *QUANTILES, F.col("highest").alias("max"), "iqr", "lower_fence", "upper_fence",
        F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"),
        F.when(n > 0, pct(F.col("outlier_count"), n)).otherwise(F.lit(0.0)).alias("outlier_pct"),
        "zero_count", F.when(n > 0, pct(F.col("zero_count"), n)).otherwise(F.lit(0.0)).alias("zero_pct"),
    ).orderBy("is_binary_like", F.desc("null_pct"), "column")


def period_counts(df: DataFrame, columns: Sequence[str], pattern: str) -> DataFrame:
    """Rows per column and calendar period (``yyyy`` or ``yyyy-MM``)."""
    periods = {c: F.date_format(F.col(c).cast("timestamp"), pattern) for c in columns}
    return frequencies(df, periods, keep_nulls=False).select("column", F.col("value").alias("period"), F.col("n").alias("count"))


def datetime_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range, years and the modal year and month (earliest on ties) from one month-level shuffle."""
    months = period_counts(df, columns, "yyyy-MM")
    year = F.col("period").substr(1, 4)
    years = months.groupBy("column", year.alias("year")).agg(F.sum("count").alias("count"))

    def modal(table: DataFrame, period: str, name: str) -> DataFrame:
        """Keys are calendar periods: a few hundred rows per column."""
        first = Window.partitionBy("column").orderBy(F.desc("count"), period)
        return table.withColumn("r", F.row_number().over(first)).filter("r = 1").select("column", F.col(period).alias(name))

    spans = years.groupBy("column").agg(
        F.min("year").cast("int").alias("min_year"), F.max("year").cast("int").alias("max_year"), F.count(F.lit(1)).alias("distinct_years")
    )
    bounds = wide_to_rows(df, {
        c: {"non_null": F.count(c), "min_datetime": F.min(F.col(c).cast("timestamp")), "max_datetime": F.max(F.col(c).cast("timestamp"))} for c in columns
    }, {"rows": F.count(F.lit(1))})
    joined = bounds
    for side in (spans, modal(years, "year", "modal_year"), modal(months, "period", "modal_month")):
        joined = joined.join(F.broadcast(side), "column", "left")
    return joined.select(
        "column", F.col("non_null").alias("non_null_count"), (F.col("rows") - F.col("non_null")).alias("null_count"),
        pct(F.col("rows") - F.col("non_null"), F.col("rows")).alias("null_pct"), "min_datetime", "max_datetime", "min_year", "max_year",
        F.coalesce("distinct_years", F.lit(0)).alias("distinct_years"), F.col("modal_year").cast("int").alias("modal_year"), "modal_month",
    ).orderBy(F.desc("non_null_count"), "column")


def text_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank and short shares and length statistics; a null text has length 0."""
    lengths = df.select(*[F.length(F.coalesce(F.col(c), F.lit(""))).cast("double").alias(f"__len_{c}") for c in columns],
                        *[F.col(c).isNotNull().alias(f"__has_{c}") for c in columns],
                        *[(X.trimmed(F.col(c)) == "").alias(f"__blank_{c}") for c in columns])
    counts = wide_to_rows(lengths, {
        c: {"non_null_count": F.count_if(F.col(f"__has_{c}")), "blank": F.count_if(F.col(f"__blank_{c}")),
            "short": F.count_if(F.col(f"__len_{c}") < SHORT_TEXT), "mean_length": F.avg(f"__len_{c}"),
            "max_length": F.max(f"__len_{c}").cast("long")} for c in columns
    }, {"rows": F.count(F.lit(1))})
    quantiles = exact_quantiles(lengths, {c: F.col(f"__len_{c}") for c in columns}, {"median_length": 0.5, "p95_length": 0.95})
    return counts.join(F.broadcast(quantiles), "column", "left").select(
        "column", "non_null_count", (F.col("rows") - F.col("non_null_count")).alias("null_count"),
        pct(F.col("blank"), F.col("rows")).alias("blank_pct"), pct(F.col("short"), F.col("rows")).alias("short_pct"),
        F.round("mean_length", 4).alias("mean_length"), F.round("median_length", 4).alias("median_length"),
        F.round("p95_length", 4).alias("p95_length"), "max_length",
    )


def temporal_summary(df: DataFrame, dates: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Range of dates (as text) and min/max/mean/median of day metrics."""
    def shown(c: Column) -> Column:
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")

    measures = {c: {"kind": F.lit("datetime"), "non_null_count": F.count(c), "min": shown(F.min(c)), "max": shown(F.max(c)),
                    "mean": F.lit(None).cast("double")} for c in dates}
    measures |= {c: {"kind": F.lit("days"), "non_null_count": F.count(c), "min": F.min(c).cast("string"),
                     "max": F.max(c).cast("string"), "mean": F.avg(c)} for c in metrics}
    df = df.select(*dates, *[present(df, c).alias(c) for c in metrics])
    rows = wide_to_rows(df, measures, {"rows": F.count(F.lit(1))})
    medians = exact_medians(df, list(metrics)).select("column", "median")
    return rows.join(F.broadcast(medians), "column", "left").select(
        "column", "kind", "non_null_count", (F.col("rows") - F.col("non_null_count")).alias("null_count"), "min", "max", "mean", "median"
    )


def score_profile(df: DataFrame, scores: Sequence[str], labels: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Scores with numeric statistics, labels with their top share, flags with their positive rate."""
    kept = [finite(F.col(c)).alias(c) if c in scores else F.col(c) for c in dict.fromkeys((*scores, *labels, *flags))]
    df = materialise(df.select(*kept))  # read by four reductions
    rows = F.count(F.lit(1))
    base = wide_to_rows(df, {
        c: {"non_null_count": F.count(c), "mean": F.avg(F.col(c).cast("double")) if c in scores else F.lit(None).cast("double"),
            "positive": F.count_if(F.col(c).cast("double") > 0) if c in flags else F.lit(None).cast("long")}
        for c in (*scores, *labels, *flags)
    }, {"rows": rows})
    quantiles = exact_quantiles(df, list(scores), {"p25": 0.25, "median": 0.5, "p75": 0.75})
    top = top_values(df, labels, 1, keep_nulls=True).select("column", F.col("value").alias("top_category"), F.col("n").alias("top_count"))
    joined = base.join(F.broadcast(quantiles.drop("n")), "column", "left").join(F.broadcast(top), "column", "left")
    kind = F.when(F.col("column").isin(*scores), "numeric").when(F.col("column").isin(*labels), "categorical").otherwise("binary_indicator")
    return joined.select(
        "column", kind.alias("profile_type"), "non_null_count", (F.col("rows") - F.col("non_null_count")).alias("null_count"),
        pct(F.col("rows") - F.col("non_null_count"), F.col("rows")).alias("null_pct"), "mean", "median",
        F.col("lowest").alias("min"), "p25", "p75", F.col("highest").alias("max"), "top_category",
        pct(F.col("top_count"), F.col("rows")).alias("top_share_pct"), pct(F.col("positive"), F.col("rows")).alias("positive_rate_pct"),
    ).orderBy("profile_type", "column")


def mode_value(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent non-null value, the smallest on ties."""
    return top_values(df, columns, 1).select("column", F.col("value").alias("mode_value"), F.col("n").alias("mode_count"))


def overview(df: DataFrame, identifiers: Sequence[str], groups: Mapping[str, int] | None = None) -> DataFrame:
    """Rows, columns, exact duplicates, distinct identifiers and columns per semantic group."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("exact_duplicate_rows")
    )
    distinct = frequencies(df, identifiers, keep_nulls=False).groupBy("column").agg(F.count(F.lit(1)).alias("levels"))
    one = distinct.agg(*[F.max(F.when(F.col("column") == c, F.col("levels"))).alias(f"{c}_unique") for c in identifiers])
    return copies.select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), "exact_duplicate_rows",
        *[one.select(f"{c}_unique").scalar().alias(f"{c}_unique") for c in identifiers],
        *[F.lit(v).alias(f"n_{k}_columns") for k, v in (groups or {}).items()],
    )


# -- bivariate --------------------------------------------------------------


def numeric_by_group(df: DataFrame, value: str, group: str, keep_null_group: bool = False) -> DataFrame:
    """count, mean, std, median, min, max of a number per category."""
    rows = df.select(group, finite(F.col(value)).alias(value)).filter(F.col(value).isNotNull())
    if not keep_null_group:
        rows = rows.filter(F.col(group).isNotNull())
    stats = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
        F.when(F.count(F.lit(1)) == 1, F.lit(0.0)).otherwise(F.stddev_samp(value)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    medians = exact_medians(rows, [value], [group]).select(group, "median")
    return null_safe_join(stats, medians, [group]).select(group, "n", "mean", "median", "std", "min", "max")


def rate_by_group(df: DataFrame, flag: str, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(flag).alias("n"), mean_pct(F.col(flag).cast("int")).alias("rate_pct"))


def medians_by_group(df: DataFrame, metrics: Sequence[str], group: str) -> DataFrame:
    """Median of several metrics per category, one column per metric, null category kept."""
    medians = exact_medians(df, list(metrics), [group])
    wide = medians.groupBy(group).agg(*[F.max(F.when(F.col("column") == m, F.col("median"))).alias(m) for m in metrics])
    return null_safe_join(df.select(group).distinct(), wide, [group], "left")


def melt(df: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    return df.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [key], list(metrics), "metric", "value"
    ).filter(F.col("value").isNotNull())


def crosstab_long(df: DataFrame, index: str, column: str, top_index: int | None = None) -> DataFrame:
    """Non-empty cells of a cross-tab; rows with a null on either side are left out."""
    cells = df.filter(F.col(index).isNotNull() & F.col(column).isNotNull()).groupBy(index, column).agg(F.count(F.lit(1)).alias("n"))
    if top_index is None:
        return cells
    totals = cells.groupBy(index).agg(F.sum("n").alias("total")).orderBy(F.desc("total"), index).limit(top_index)
    return cells.join(F.broadcast(totals.select(index)), index, "left_semi")


def crosstab(df: DataFrame, index: str, column: str, levels: Sequence[str], top_index: int | None = None) -> DataFrame:
    """Cross-tab with one column per given level and ``other`` for the rest, zero-filled. The pivot runs on the cells, not on rows."""
    cells = crosstab_long(df, index, column, top_index)
    counted = [F.sum(F.when(F.col(column) == level, F.col("n")).otherwise(0)).alias(level) for level in levels]
    return cells.groupBy(index).agg(*counted, F.sum(F.when(F.col(column).isin(*levels), 0).otherwise(F.col("n"))).alias("other"))


def entity_rollup(df: DataFrame, keys: Sequence[str], id_column: str, completeness: str, indicators: Sequence[str]) -> DataFrame:
    """Processes and mean indicators (in percent) per entity; null keys form their own groups."""
    return df.groupBy(*keys).agg(
        F.count(id_column).alias("processes"),
        mean_pct(F.col(completeness)).alias("mean_completeness_pct"),
        *[mean_pct(F.col(c).cast("int")).alias(f"{c}_pct") for c in indicators],
    )

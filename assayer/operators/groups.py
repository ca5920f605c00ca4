"""Group comparisons: numeric outcome by category, for many (outcome, group) pairs at once.

Rows are laid out as (pair, level, value) with rare categories collapsed and
small groups left out. All tests are computed from two reductions of that
table: moments per (pair, level), and counts per (pair, value) with one column
per level. Levels are bounded by ``top_n + 1``, pairs by the caller's list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import pvalues as PV
from assayer.functions.numbers import finite
from assayer.functions.text import normalize_text
from assayer.operators.kernels import exact_medians, running_counts
from assayer.operators.lookups import holm
from assayer.operators.profile import _top, present
from assayer.session import materialise
from assayer.spec import LARGE_SAMPLE

OTHER = "Other"
SHAPIRO_MOST = 5000  # values for which the published approximation holds
MAX_POSTHOC_GROUPS = 6

Pairs = Sequence[tuple[str, str]]


def pair_name(left: str, right: str) -> str:
    return f"{left}|{right}"


def group_label(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(column).cast("int").cast("string")
    if isinstance(kind, T.NumericType):
        number = F.col(column)
        whole = number.cast("bigint").cast("string")
        if isinstance(kind, T.IntegralType):
            return whole
        number = present(df, column)
        return F.when(number == F.floor(number), whole).otherwise(number.cast("string"))
    return normalize_text(F.col(column))


def collapsed_levels(counts: DataFrame, top_n: int, min_size: int, min_levels: int = 2) -> tuple[DataFrame, DataFrame]:
    """From (pair, label, n): labels kept per pair, and the valid levels with their sizes.

    Sizes follow from the counts alone: the kept labels, and one ``Other`` for what remains.
    """
    kept = _top(counts, ["pair"], top_n, value="label").select("pair", "label", "n")
    totals = counts.groupBy("pair").agg(F.sum("n").alias("total"))
    rest = kept.groupBy("pair").agg(F.sum("n").alias("kept")).join(F.broadcast(totals), "pair")
    other = rest.filter("total > kept").select("pair", F.lit(OTHER).alias("level"), (F.col("total") - F.col("kept")).alias("n"))
    levels = kept.withColumnRenamed("label", "level").unionByName(other).groupBy("pair", "level").agg(F.sum("n").alias("n"))
    valid = levels.filter(F.col("n") >= min_size)
    count = F.count(F.lit(1)).over(Window.partitionBy("pair"))
    return kept.select("pair", "label"), valid.withColumn("k", count).filter(F.col("k") >= min_levels)


def long_pairs(df: DataFrame, pairs: Pairs, marked: bool = False) -> DataFrame:
    """(pair, label, value), complete cases only; ``marked`` adds a hash of the row for sampling."""
    cells = [
        F.struct(F.lit(pair_name(o, g)).alias("pair"), group_label(df, g).alias("label"), finite(F.col(o)).alias("value")) for o, g in pairs
    ]
    mark = [F.xxhash64(*df.columns, F.lit(42)).alias("mark")] if marked else []
    complete = F.col("label").isNotNull() & F.col("value").isNotNull()
    return df.select(*mark, F.inline(F.array(*cells))).filter(complete)


def group_frame(
    df: DataFrame, pairs: Pairs, top_n: int = 8, min_size: int = 30, marked: bool = False, reused: bool = True
) -> DataFrame:
    """(pair, level, value) ready for testing; pairs with fewer than two valid groups are absent.

    ``reused`` writes the frame once, since most tests read it several times.
    """
    long = long_pairs(df, pairs, marked)
    counts = long.groupBy("pair", "label").agg(F.count(F.lit(1)).alias("n"))
    kept, valid = collapsed_levels(counts, top_n, min_size)
    # Both lists have at most (top_n + 1) rows per pair.
    named = long.join(F.broadcast(kept.withColumn("level", F.col("label"))), ["pair", "label"], "left")
    named = named.withColumn("level", F.coalesce("level", F.lit(OTHER))).drop("label")
    frame = named.join(F.broadcast(valid.select("pair", "level")), ["pair", "level"], "left_semi")
    return materialise(frame) if reused else frame


def skip_reasons(df: DataFrame, pairs: Pairs, top_n: int = 8, min_size: int = 30) -> DataFrame:
    """Pairs without a usable frame and why."""
    spark = df.sparkSession
    counts = long_pairs(df, pairs).groupBy("pair", "label").agg(F.count(F.lit(1)).alias("n"))
    _, valid = collapsed_levels(counts, top_n, min_size)
    listed = spark.createDataFrame([(pair_name(o, g), o, g) for o, g in pairs], "pair string, outcome_column string, group_column string")
    seen = counts.groupBy("pair").agg(F.sum("n").alias("n_complete"))
    usable = valid.groupBy("pair").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_used"))
    joined = listed.join(F.broadcast(seen), "pair", "left").join(F.broadcast(usable), "pair", "left")
    reason = F.when(F.col("n_complete").isNull(), "no_complete_cases").when(F.col("n_groups").isNull(), "insufficient_valid_groups")
    return joined.select(
        "pair", "outcome_column", "group_column", F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"),
        F.when(reason.isNull(), "ok").otherwise("skipped").alias("status"), reason.alias("skip_reason"),
    )


# -- moments ----------------------------------------------------------------


def moments(frame: DataFrame) -> DataFrame:
    return frame.groupBy("pair", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var")
    )


def level_pairs(table: DataFrame) -> DataFrame:
    """Two-by-two combinations of the levels of a pair, from a table with one row per level (at most top_n + 1)."""
    left = table.select("pair", *[F.col(c).alias(f"a_{c}") for c in table.columns if c != "pair"])
    right = table.select("pair", *[F.col(c).alias(f"b_{c}") for c in table.columns if c != "pair"])
    return left.join(F.broadcast(right), "pair").filter(F.col("a_level") < F.col("b_level"))


def welch(frame: DataFrame, shared: Shared | None = None) -> DataFrame:
    """Welch t for every two levels of each pair, with Cohen's d; the first level is the alphabetically first."""
    both = level_pairs((shared.levels if shared else moments(frame)).select("pair", "level", "n", "mean", "var"))
    va, vb = F.col("a_var") / F.col("a_n"), F.col("b_var") / F.col("b_n")
    gap = F.col("a_mean") - F.col("b_mean")
    pooled = ((F.col("a_n") - 1) * F.col("a_var") + (F.col("b_n") - 1) * F.col("b_var")) / (F.col("a_n") + F.col("b_n") - 2)
    return both.select(
        "pair", F.col("a_level").alias("left_group"), F.col("b_level").alias("right_group"), F.col("a_n").alias("n_left"), F.col("b_n").alias("n_right"),
        F.when(va + vb > 0, gap / F.sqrt(va + vb)).alias("t"),
        F.when(va + vb > 0, (va + vb) * (va + vb) / (va * va / (F.col("a_n") - 1) + vb * vb / (F.col("b_n") - 1))).alias("df"),
        F.when(pooled > 0, gap / F.sqrt(pooled)).alias("cohens_d"),
    )


def _anova(levels: DataFrame) -> DataFrame:
    """F and eta squared per pair from (pair, n, mean, var) rows."""
    totals = levels.groupBy("pair").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand")
    )
    joined = levels.join(F.broadcast(totals), "pair")
    squares = joined.groupBy("pair", "k", "n_total").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"),
        F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
    )
    ratio = (F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("n_total") - F.col("k")))
    total = F.col("between") + F.col("within")
    return squares.select(
        "pair", F.col("k").alias("n_groups"), F.col("n_total").alias("n_used"),
        F.when((F.col("within") > 0) & (F.col("n_total") > F.col("k")), ratio).alias("f"),
        (F.col("k") - 1).alias("df_between"), (F.col("n_total") - F.col("k")).alias("df_within"),
        F.when(total > 0, F.col("between") / total).alias("eta_squared"),
    )


def anova(frame: DataFrame, shared: Shared | None = None) -> DataFrame:
    return _anova(shared.levels if shared else moments(frame))


def levene(frame: DataFrame, shared: Shared | None = None) -> DataFrame:
    """Spread test centred on the median: one-way ANOVA of absolute distances to the group median.

    With ``shared`` the distances' squares follow from each level's moments and median and no rows are read; alone, a search for the
    medians is cheaper than ranks.
    """
    if not shared:
        medians = exact_medians(frame, ["value"], ["pair", "level"], few_keys=True).select("pair", "level", "median")
        spread = frame.join(F.broadcast(medians), ["pair", "level"]).select("pair", "level", F.abs(F.col("value") - F.col("median")).alias("value"))
        return _anova(moments(spread)).withColumnRenamed("f", "w").drop("eta_squared")
    levels = shared.levels
    n, shift = F.col("n"), F.col("mean") - F.col("median")
    squares = (n - 1) * F.col("var") + n * shift * shift
    mean = F.col("distance") / n
    spread = levels.select("pair", "level", "n", mean.alias("mean"), F.when(n > 1, F.greatest(F.lit(0.0), squares - n * mean * mean) / (n - 1)).otherwise(0.0).alias("var"))
    return _anova(spread).withColumnRenamed("f", "w").drop("eta_squared")


def group_stats(frame: DataFrame, shared: Shared | None = None) -> DataFrame:
    """n, mean, median, std, min, max of each level."""
    if shared:
        return shared.levels.select("pair", "level", "n", "mean", F.sqrt("var").alias("std"), "min", "max", "median")
    base = frame.groupBy("pair", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    medians = exact_medians(frame, ["value"], ["pair", "level"], few_keys=True).select("pair", "level", "median")
    return base.join(F.broadcast(medians), ["pair", "level"])


# -- ranks ------------------------------------------------------------------


@dataclass(frozen=True)
class Shared:
    """What the tests of one group frame share, both written and of a few rows for each pair.

    ``levels``: pair, level, position, n, mean, var, min, max, median and distance, the sum of absolute distances to the median.
    ``sums``: for each pair what rank tests need of its running counts.
    """

    levels: DataFrame
    sums: DataFrame
    width: int


def _legend(frame: DataFrame, max_levels: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("pair").orderBy("level")) - 1  # at most max_levels rows a pair
    legend = materialise(frame.groupBy("pair", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("var"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    ).withColumn("position", place))
    found = (legend.agg(F.max("position")).first()[0] or 0) + 1
    if found > max_levels:
        raise ValueError(f"the frame has {found} levels in a pair, {max_levels} are provided for")
    return legend


def _value_counts(frame: DataFrame, legend: DataFrame, width: int) -> DataFrame:
    """Rows per (pair, value), one column for each level; a value shared by very many rows is a single row."""
    placed = frame.join(F.broadcast(legend.select("pair", "level", "position")), ["pair", "level"])
    return materialise(placed.groupBy("pair", "value").agg(*[F.count_if(F.col("position") == i).alias(f"c{i}") for i in range(width)]))


def _running(counts: DataFrame, width: int, range_rows: int | None) -> DataFrame:
    return running_counts(counts, ["pair"], [f"c{i}" for i in range(width)], written=True, **({"range_rows": range_rows} if range_rows else {}))


def _kruskal_sums(width: int) -> list[Column]:
    tied = sum((F.col(f"c{i}") for i in range(1, width)), F.col("c0"))
    below = sum((F.col(f"below_c{i}") for i in range(1, width)), F.col("below_c0"))
    rank = below + (tied + 1) / F.lit(2.0)
    return [
        F.sum(tied).alias("n"), F.sum(_cube(tied)).alias("ties"),
        *[F.sum(f"c{i}").alias(f"n{i}") for i in range(width)], *[F.sum(F.col(f"c{i}") * rank).alias(f"r{i}") for i in range(width)],
    ]


def _u_sums(combos: Sequence[tuple[int, int]]) -> list[Column]:
    return [
        part
        for i, j in combos
        for part in (
            F.sum(F.col(f"c{i}") * (F.col(f"below_c{j}") + F.col(f"c{j}") / F.lit(2.0))).alias(f"u_{i}_{j}"),
            F.sum(_cube(F.col(f"c{i}") + F.col(f"c{j}"))).alias(f"t_{i}_{j}"),
        )
    ]


def shared_ranks(frame: DataFrame, max_levels: int = 9, range_rows: int | None = None) -> Shared:
    """Moments, medians, distances and rank sums of all levels from one table of counts per value.

    The rows are read twice, for moments and for counts. Running counts over the counts give rank sums and, where they pass the
    middle ranks, medians; a second look at the counts gives the distances to the medians.
    """
    legend = _legend(frame, max_levels)
    counts = _value_counts(frame, legend, max_levels)
    span = range(max_levels)
    sizes = legend.groupBy("pair").agg(*[F.max(F.when(F.col("position") == i, F.col("n"))).alias(f"size{i}") for i in span])

    def at(i: int, rank: Column) -> Column:
        return F.max(F.when((F.col(f"below_c{i}") <= rank) & (rank < F.col(f"below_c{i}") + F.col(f"c{i}")), F.col("value")))

    middles = [m for i in span for m in (at(i, F.floor((F.col(f"size{i}") - 1) / 2)).alias(f"a{i}"), at(i, F.floor(F.col(f"size{i}") / 2)).alias(f"b{i}"))]
    combos = [(0, 1)] if max_levels > 1 else []
    running = _running(counts, max_levels, range_rows).join(F.broadcast(sizes), "pair")
    sums = materialise(running.groupBy("pair").agg(*_kruskal_sums(max_levels), *_u_sums(combos), *middles))
    median = [(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * 0.5).alias(f"m{i}") for i in span]
    middle = sums.select("pair", *median)
    far = counts.join(F.broadcast(middle), "pair").groupBy("pair").agg(*[F.sum(F.col(f"c{i}") * F.abs(F.col("value") - F.col(f"m{i}"))).alias(f"d{i}") for i in span])
    told = middle.join(F.broadcast(far), "pair").select(
        "pair", F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.col(f"m{i}").alias("median"), F.col(f"d{i}").alias("distance")) for i in span])))
    return Shared(materialise(legend.join(F.broadcast(told), ["pair", "position"])), sums, max_levels)


def _cube(t: Column) -> Column:
    t = t.cast("double")
    return t * t * t - t


def kruskal(frame: DataFrame, top_n: int = 8, range_rows: int | None = None, shared: Shared | None = None) -> DataFrame:
    """Kruskal-Wallis H with tie correction and epsilon squared."""
    levels = shared.width if shared else top_n + 1
    if shared:
        sums = shared.sums
    else:
        counts = _value_counts(frame, _legend(frame, levels), levels)
        sums = _running(counts, levels, range_rows).groupBy("pair").agg(*_kruskal_sums(levels))
    squared, groups = F.lit(0.0), F.lit(0)
    for i in range(levels):
        squared = squared + F.when(F.col(f"n{i}") > 0, F.col(f"r{i}") * F.col(f"r{i}") / F.col(f"n{i}")).otherwise(0.0)
        groups = groups + (F.col(f"n{i}") > 0).cast("int")
    n = F.col("n").cast("double")
    correction = 1 - F.col("ties") / (n * n * n - n)
    h = (F.lit(12.0) / (n * (n + 1)) * squared - 3 * (n + 1)) / correction
    return sums.select(
        "pair", F.col("n").alias("n_used"), groups.alias("n_groups"), F.when(correction > 0, h).alias("h"), (groups - 1).alias("df")
    ).withColumn("epsilon_squared", F.when(F.col("n_used") > F.col("n_groups"), (F.col("h") - F.col("n_groups") + 1) / (F.col("n_used") - F.col("n_groups"))))


def too_many_levels(frame: DataFrame, max_levels: int = MAX_POSTHOC_GROUPS) -> DataFrame:
    """(pair, n_groups) that a pairwise comparison of at most ``max_levels`` levels leaves out."""
    return frame.groupBy("pair").agg(F.count_distinct("level").alias("n_groups")).filter(F.col("n_groups") > max_levels)


def mann_whitney(frame: DataFrame, max_levels: int = 2, range_rows: int | None = None) -> DataFrame:
    """U, tie-corrected z with continuity, and rank-biserial r for every two levels of each pair.

    U counts, for each value, the members of the second level below it. Running
    counts per level give every combination in one pass; no ranks are assigned per combination.
    Only pairs of at most ``max_levels`` levels are compared; ``too_many_levels`` lists the others.
    """
    sizes = frame.groupBy("pair").agg(F.count_distinct("level").alias("k")).filter(F.col("k") <= max_levels)
    fit = frame.join(F.broadcast(sizes.select("pair")), "pair", "left_semi")
    combos = list(combinations(range(max_levels), 2))
    legend = _legend(fit, max_levels)
    sums = _running(_value_counts(fit, legend, max_levels), max_levels, range_rows).groupBy("pair").agg(*_u_sums(combos))
    return _mann_whitney(sums, legend, combos)


def _mann_whitney(sums: DataFrame, legend: DataFrame, combos: Sequence[tuple[int, int]]) -> DataFrame:
    rows = sums.select("pair", F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"u_{i}_{j}").alias("u"), F.col(f"t_{i}_{j}").alias("ties")) for i, j in combos
    ])))
    first = legend.select("pair", F.col("position").alias("i"), F.col("level").alias("left_group"), F.col("n").alias("n_left"))
    second = legend.select("pair", F.col("position").alias("j"), F.col("level").alias("right_group"), F.col("n").alias("n_right"))
    joined = rows.join(F.broadcast(first), ["pair", "i"]).join(F.broadcast(second), ["pair", "j"])
    a, b = F.col("n_left").cast("double"), F.col("n_right").cast("double")
    n = a + b
    spread = F.sqrt(a * b / 12.0 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    far = F.greatest(F.col("u"), a * b - F.col("u"))
    return joined.select(
        "pair", "left_group", "right_group", "n_left", "n_right", "u", F.when(spread > 0, (far - a * b / 2.0 - 0.5) / spread).alias("z"),
        (2 * F.col("u") / (a * b) - 1).alias("rank_biserial"),
    )


# -- normality, choice and dispatch -----------------------------------------


def normality(frame: DataFrame) -> DataFrame:
    """D'Agostino-Pearson test of every (pair, level) over all of its rows: n, k2, p_value.

    Skewness and kurtosis are turned into normal scores, whose squares have a chi-square with two degrees of freedom and so a
    closed tail. Levels of under 8 rows or without spread get nulls.
    """
    stats = frame.groupBy("pair", "level").agg(
        F.count(F.lit(1)).alias("n"), F.skewness("value").alias("g1"), (F.kurtosis("value") + 3).alias("b2"), F.var_pop("value").alias("spread")
    )
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w = F.sqrt(2 * (beta - 1)) - 1
    scaled = y / F.sqrt(F.lit(2.0) / (w - 1))
    skew_score = F.lit(1.0) / F.sqrt(0.5 * F.log(w)) * F.asinh(scaled)
    x = (F.col("b2") - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    under = 1 + x * F.sqrt(F.lit(2.0) / (a - 4))
    kurtosis_score = (1 - F.lit(2.0) / (9 * a) - F.signum(under) * F.cbrt((1 - F.lit(2.0) / a) / F.abs(under))) / F.sqrt(F.lit(2.0) / (9 * a))
    tested = (F.col("n") >= 8) & (F.col("spread") > 0)
    k2 = F.when(tested, skew_score * skew_score + kurtosis_score * kurtosis_score)
    return stats.select("pair", "level", "n", k2.alias("k2"), F.exp(-k2 / 2).alias("p_value"))


def shapiro(frame: DataFrame) -> DataFrame:
    """Shapiro-Wilk per (pair, level), over all rows of each level of 3 to SHAPIRO_MOST rows.

    The test is not defined beyond; larger levels have a row with their size and nulls, ``normality`` covers them.
    """
    sizes = frame.groupBy("pair", "level").agg(F.count(F.lit(1)).alias("n"))
    fits = F.col("n").between(3, SHAPIRO_MOST)

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = PV.shapiro_wilk(pdf["value"].to_numpy())
        return pd.DataFrame({"pair": [key[0]], "level": [key[1]], "n": [len(pdf)], "w": [w], "p_value": [p]})

    columns = "pair string, level string, n long, w double, p_value double"
    held = frame.join(F.broadcast(sizes.filter(fits).select("pair", "level")), ["pair", "level"], "left_semi")
    missing = F.lit(None).cast("double")
    beyond = sizes.filter(~fits).select("pair", "level", "n", missing.alias("w"), missing.alias("p_value"))
    return held.groupBy("pair", "level").applyInPandas(test, columns).unionByName(beyond)


def assumptions(frame: DataFrame, shared: Shared | None = None) -> DataFrame:
    """Normality (all rows) and equal spread per pair, and whether a parametric test is advised."""
    normal = normality(frame).groupBy("pair").agg(
        F.min("p_value").alias("normality_p_min"), F.every(F.col("p_value") >= 0.05).alias("all_groups_normal")
    )
    spread = levene(frame, shared).withColumn("homoscedasticity_p", PV.p_f("w", F.col("df_between").cast("double"), F.col("df_within").cast("double")))
    joined = spread.join(F.broadcast(normal), "pair", "left")
    equal = F.coalesce(F.col("homoscedasticity_p") >= 0.05, F.lit(False))
    normal_ok = F.coalesce("all_groups_normal", F.lit(False))
    return joined.select(
        "pair", "n_used", "n_groups", "normality_p_min", normal_ok.alias("all_groups_normal"), F.col("w").alias("levene_w"), "homoscedasticity_p",
        equal.alias("homoscedastic"), F.when(F.col("n_groups") == 2, normal_ok).otherwise(normal_ok & equal).alias("parametric_recommended"),
        (F.col("n_used") >= LARGE_SAMPLE).alias("large_sample_warning"),
    )


def _double(*names: str) -> list[Column]:
    return [F.col(n).cast("double") for n in names]


def compare(frame: DataFrame, assumed: DataFrame, top_n: int = 8, shared: Shared | None = None) -> DataFrame:
    """The test each pair calls for: Welch or Mann-Whitney for two groups, ANOVA or Kruskal-Wallis for more.

    All statistics come from the ``shared`` table of the frame; ``assumed`` is written once, as several steps read it.
    """
    shared = shared or shared_ranks(frame, top_n + 1)
    assumed = materialise(assumed)
    t = welch(frame, shared).select("pair", "t", "df", F.col("cohens_d")).withColumn("t_p", PV.p_t("t", "df"))
    two = F.broadcast(assumed.filter("n_groups = 2").select("pair"))
    t = t.join(two, "pair", "left_semi")
    pairs = _mann_whitney(shared.sums.join(two, "pair", "left_semi"), shared.levels, [(0, 1)])
    u = pairs.select("pair", "u", "rank_biserial", "z").withColumn("u_p", F.least(F.lit(1.0), PV.p_normal("z"))).drop("z")
    f = anova(frame, shared).select("pair", "f", "eta_squared", "df_between", "df_within").withColumn(
        "f_p", PV.p_f("f", *_double("df_between", "df_within"))
    ).drop("df_between", "df_within")
    h = kruskal(frame, top_n, shared=shared).join(F.broadcast(assumed.filter("n_groups > 2").select("pair")), "pair", "left_semi").select("pair", "h", "epsilon_squared", F.col("df").alias("h_df")).withColumn(
        "h_p", PV.p_chi2("h", F.col("h_df").cast("double"))
    ).drop("h_df")
    joined = assumed
    for part in (t, u, f, h):  # one row per pair each
        joined = joined.join(F.broadcast(part), "pair", "left")
    case = F.when(F.col("n_groups") == 2, F.when(F.col("parametric_recommended"), 0).otherwise(1)).otherwise(
        F.when(F.col("parametric_recommended"), 2).otherwise(3)
    )

    def pick(*options: Column) -> Column:
        return F.when(case == 0, options[0]).when(case == 1, options[1]).when(case == 2, options[2]).otherwise(options[3])

    return joined.select(
        "pair", pick(*[F.lit(x) for x in ("Welch t-test", "Mann-Whitney U", "ANOVA", "Kruskal-Wallis")]).alias("test_name"), "n_used", "n_groups",
        pick(F.col("t"), F.col("u"), F.col("f"), F.col("h")).alias("statistic"), pick(F.col("t_p"), F.col("u_p"), F.col("f_p"), F.col("h_p")).alias("p_value"),
        pick(*[F.lit(x) for x in ("cohens_d", "rank_biserial", "eta_squared", "epsilon_squared")]).alias("effect_size_name"),
        pick(F.col("cohens_d"), F.col("rank_biserial"), F.col("eta_squared"), F.col("epsilon_squared")).alias("effect_size_value"),
        "parametric_recommended", "large_sample_warning",
    )


def posthoc(frame: DataFrame, parametric: DataFrame | None = None, compared: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """Every two groups of pairs with 3 to 6 groups, Holm-adjusted inside the pair.

    ``parametric`` lists (pair, parametric_recommended); without it the rank test is used. ``compared`` lists (pair, p_value) of
    the overall tests: only pairs with a difference at ``alpha`` are followed up.
    """
    if compared is not None:
        frame = frame.join(F.broadcast(compared.filter(F.col("p_value") < alpha).select("pair")), "pair", "left_semi")
    rank = mann_whitney(frame, MAX_POSTHOC_GROUPS)
    sizes = rank.groupBy("pair").agg(F.count(F.lit(1)).alias("tests")).filter("tests >= 3").select("pair")
    u = rank.join(F.broadcast(sizes), "pair", "left_semi").withColumn("p", F.least(F.lit(1.0), PV.p_normal("z")))
    rows = u.select("pair", "left_group", "right_group", "n_left", "n_right", F.lit("Mann-Whitney U").alias("test_name"), F.col("u").alias("statistic"), F.col("p").alias("raw_p_value"))
    if parametric is not None:
        chosen = parametric.filter("parametric_recommended").select("pair")
        t = welch(frame).join(F.broadcast(chosen), "pair", "left_semi").join(F.broadcast(sizes), "pair", "left_semi").withColumn("p", PV.p_t("t", "df"))
        tested = t.select("pair", "left_group", "right_group", "n_left", "n_right", F.lit("Welch t-test").alias("test_name"), F.col("t").alias("statistic"), F.col("p").alias("raw_p_value"))
        rows = rows.join(F.broadcast(chosen), "pair", "left_anti").unionByName(tested)
    return holm(rows, "raw_p_value", ["pair"], ["left_group", "right_group"])


def described(frame: DataFrame, shared: Shared | None = None) -> DataFrame:
    """Group statistics of each pair as one JSON list (at most top_n + 1 entries)."""
    stats = group_stats(frame, shared)
    entry = F.struct("level", "n", "mean", "median", "std", "min", "max")
    return stats.groupBy("pair").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("descriptive_stats"))

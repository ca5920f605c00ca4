"""Association between two columns: chi-square, Fisher, Pearson, Spearman, covariance."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import pvalues as PV
from assayer.functions.numbers import finite
from assayer.operators.groups import OTHER, collapsed_levels, group_label, pair_name
from assayer.operators.kernels import SMALL_SIDE_ROWS, attach_by_value, running_counts
from assayer.session import materialise
from assayer.spec import LARGE_SAMPLE

MIN_COMPLETE = 30


def allowed_pairs(columns: Sequence[str], exclude: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    banned = {frozenset(p) for p in exclude}
    return [p for p in combinations(columns, 2) if frozenset(p) not in banned]


# -- categorical ------------------------------------------------------------


def pair_cells(df: DataFrame, pairs: Sequence[tuple[str, str]], top_n: int = 8, min_size: int = 30) -> DataFrame:
    """Contingency cells (pair, left_level, right_level, n) of all pairs from one shuffle.

    Rare levels are collapsed on both sides and levels below ``min_size`` left
    out. Everything after the first count works on counts, not on rows.
    """
    cells = [
        F.struct(F.lit(pair_name(a, b)).alias("pair"), group_label(df, a).alias("l"), group_label(df, b).alias("r")) for a, b in pairs
    ]
    long = df.select(F.inline(F.array(*cells))).filter(F.col("l").isNotNull() & F.col("r").isNotNull())
    counted = materialise(long.groupBy("pair", "l", "r").agg(F.count(F.lit(1)).alias("n")))

    def side(name: str) -> tuple[DataFrame, DataFrame]:
        margin = counted.groupBy("pair", F.col(name).alias("label")).agg(F.sum("n").alias("n"))
        kept, valid = collapsed_levels(margin, top_n, min_size, min_levels=1)
        return kept.select("pair", F.col("label").alias(name), F.col("label").alias(f"{name}_kept")), valid.select("pair", F.col("level").alias(f"{name}_level"))

    merged = counted
    for name in ("l", "r"):
        kept, _ = side(name)  # at most top_n rows per pair
        merged = merged.join(F.broadcast(kept), ["pair", name], "left").withColumn(f"{name}_level", F.coalesce(f"{name}_kept", F.lit(OTHER))).drop(f"{name}_kept")
    collapsed = merged.groupBy("pair", "l_level", "r_level").agg(F.sum("n").alias("n"))
    for name in ("l", "r"):
        _, valid = side(name)  # at most top_n + 1 rows per pair
        collapsed = collapsed.join(F.broadcast(valid), ["pair", f"{name}_level"], "left_semi")
    return collapsed.select("pair", F.col("l_level").alias("left_level"), F.col("r_level").alias("right_level"), "n")


def chi_square(cells: DataFrame) -> DataFrame:
    """Chi-square per pair over the full grid of its levels (zero cells included), Yates-corrected for 2x2.

    Adds Cramer's V from the corrected statistic and the share of expected counts
    below five. The grid has at most (top_n + 1) squared cells per pair.
    """
    left = cells.groupBy("pair", "left_level").agg(F.sum("n").alias("row_n"))
    right = cells.groupBy("pair", "right_level").agg(F.sum("n").alias("col_n"))
    sizes = cells.groupBy("pair").agg(
        F.sum("n").alias("total"), F.count_distinct("left_level").alias("n_rows"), F.count_distinct("right_level").alias("n_cols")
    ).filter("n_rows >= 2 AND n_cols >= 2")
    grid = left.join(F.broadcast(right), "pair").join(F.broadcast(sizes), "pair").join(cells, ["pair", "left_level", "right_level"], "left")
    expected = F.col("row_n") * F.col("col_n") / F.col("total").cast("double")
    gap = F.abs(F.coalesce("n", F.lit(0)) - expected)
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    shifted = F.when(dof == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    stats = grid.groupBy("pair", "total", "n_rows", "n_cols").agg(
        F.sum(shifted * shifted / expected).alias("chi2"), (F.count_if(expected < 5) * F.lit(100.0) / F.count(F.lit(1))).alias("expected_below_5_pct")
    )
    shorter = F.least(F.col("n_rows"), F.col("n_cols")) - 1
    return stats.select(
        "pair", F.col("total").alias("n_used"), F.concat_ws("x", "n_rows", "n_cols").alias("table_shape"), "chi2", dof.alias("dof"),
        F.sqrt(F.col("chi2") / (F.col("total") * shorter)).alias("cramers_v"), "expected_below_5_pct",
    )


def two_by_two(cells: DataFrame) -> DataFrame:
    """a, b, c, d of the pairs whose table is 2x2."""
    shape = cells.groupBy("pair").agg(
        F.count_distinct("left_level").alias("nl"), F.count_distinct("right_level").alias("nr"), F.min("left_level").alias("l0"), F.min("right_level").alias("r0")
    ).filter("nl = 2 AND nr = 2")
    placed = cells.join(F.broadcast(shape), "pair")
    first, second = F.col("left_level") == F.col("l0"), F.col("right_level") == F.col("r0")

    def cell(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return placed.groupBy("pair").agg(
        cell(first & second).alias("a"), cell(first & ~second).alias("b"), cell(~first & second).alias("c"), cell(~first & ~second).alias("d")
    )


def fisher(cells: DataFrame) -> DataFrame:
    """Odds ratio and exact two-sided p-value of 2x2 tables."""
    table = two_by_two(cells)
    numbers = [F.col(c).cast("double") for c in "abcd"]
    odds = F.when(F.col("b") * F.col("c") > 0, F.col("a").cast("double") * F.col("d") / (F.col("b").cast("double") * F.col("c")))
    return table.withColumns({"odds_ratio": odds, "p_value": PV.p_fisher(*numbers)})


def sparse_fisher(cells: DataFrame) -> DataFrame:
    """Fisher's test of the 2x2 pairs that call for it: over 20 % of expected counts below five."""
    sparse = chi_square(cells).filter("table_shape = '2x2' AND expected_below_5_pct > 20").select("pair")
    return fisher(cells.join(F.broadcast(sparse), "pair", "left_semi"))


def associations(df: DataFrame, pairs: Sequence[tuple[str, str]], top_n: int = 8, min_size: int = 30) -> DataFrame:
    """Chi-square per pair; Fisher where the table is 2x2 with over 20 % of expected counts below five."""
    cells = materialise(pair_cells(df, pairs, top_n, min_size))
    chi = chi_square(cells).withColumn("chi_p", PV.p_chi2("chi2", F.col("dof").cast("double")))
    exact = sparse_fisher(cells).select("pair", "odds_ratio", F.col("p_value").alias("fisher_p"))
    listed = df.sparkSession.createDataFrame([(pair_name(a, b), a, b) for a, b in pairs], "pair string, left_column string, right_column string")
    joined = listed.join(F.broadcast(chi), "pair", "left").join(F.broadcast(exact), "pair", "left")
    is_exact = F.col("fisher_p").isNotNull()
    return joined.select(
        "left_column", "right_column", F.when(is_exact, "Fisher exact").when(F.col("chi2").isNotNull(), "Chi-square").alias("test_name"),
        F.coalesce("n_used", F.lit(0)).alias("n_used"), "table_shape", F.when(is_exact, F.col("odds_ratio")).otherwise(F.col("chi2")).alias("statistic"),
        F.when(is_exact, F.col("fisher_p")).otherwise(F.col("chi_p")).alias("p_value"), "dof", "cramers_v", "expected_below_5_pct",
        (F.coalesce("n_used", F.lit(0)) >= LARGE_SAMPLE).alias("large_sample_warning"),
        F.when(F.col("chi2").isNull(), "skipped").otherwise("ok").alias("status"), F.when(F.col("chi2").isNull(), "insufficient_valid_levels").alias("skip_reason"),
    )


# -- numeric ----------------------------------------------------------------


def _wide_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], measures) -> DataFrame:
    """One aggregate with the measures of every pair, turned into one row per pair."""
    columns = sorted({c for p in pairs for c in p})
    numbers = df.select(*[finite(F.col(c)).alias(c) for c in columns])
    aggregates, rows = [], []
    for i, (a, b) in enumerate(pairs):
        named = measures(F.col(a), F.col(b))
        aggregates += [m.alias(f"{k}_{i}") for k, m in named.items()]
        rows.append(F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), *[F.col(f"{k}_{i}").alias(k) for k in named]))
    return numbers.agg(*aggregates).select(F.inline(F.array(*rows)))


def _complete(a: Column, b: Column) -> Column:
    return F.count_if(a.isNotNull() & b.isNotNull())


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], min_complete: int = MIN_COMPLETE) -> DataFrame:
    """Pairwise-complete Pearson r of all pairs in one aggregate; too few rows give null."""
    rows = _wide_pairs(df, pairs, lambda a, b: {"n_used": _complete(a, b), "r": F.corr(a, b)})
    return rows.select("left_column", "right_column", "n_used", F.when(F.col("n_used") >= min_complete, F.nanvl("r", F.lit(None))).alias("pearson_r"))


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sample covariances, each pair once and each column with itself."""
    pairs = [*combinations(columns, 2), *[(c, c) for c in columns]]
    return _wide_pairs(df, pairs, lambda a, b: {"n_used": _complete(a, b), "covariance": F.covar_samp(a, b)})


def top_correlations(df: DataFrame, columns: Sequence[str], k: int, exclude: Iterable[tuple[str, str]] = ()) -> DataFrame:
    found = pearson(df, allowed_pairs(columns, exclude)).filter(F.col("pearson_r").isNotNull())
    return found.orderBy(F.desc(F.abs("pearson_r")), "left_column", "right_column").limit(k)


def rank_index(numbers: DataFrame, columns: Sequence[str], range_rows: int | None = None) -> DataFrame:
    """(column, value, ranks, n): for each value of a column its average ranks, one for each column as partner, and its rows.

    ``ranks[j]`` is taken among the rows in which column j is present too. Counts for all partners lie side by side, so one ordering
    of a column's values serves all of its pairs.
    """
    there = [F.col(c).isNotNull().alias(f"m{j}") for j, c in enumerate(columns)]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])
    long = numbers.select(*there, F.inline(cells)).filter(F.col("value").isNotNull())
    names = [f"n{j}" for j in range(len(columns))]
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"m{j}").alias(n) for j, n in enumerate(names)])
    placed = running_counts(counts, ["column"], names, **({"range_rows": range_rows} if range_rows else {}))
    ranks = F.array(*[F.col(f"below_{n}") + (F.col(n) + 1) / F.lit(2.0) for n in names])
    return materialise(placed.select("column", "value", "n", ranks.alias("ranks"), *names))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]], min_complete: int = MIN_COMPLETE, range_rows: int | None = None) -> DataFrame:
    """Spearman rho: Pearson on average ranks taken within each pair's complete cases.

    Ranks come from one index of (column, value) and are joined to the rows column by column: broadcast where a column has few
    values, else by a shuffle in which hot values are kept apart and nulls do not take part. One aggregate then has the sums of all pairs.
    """
    columns = sorted({c for p in pairs for c in p})
    numbers = materialise(df.select(*[finite(F.col(c)).alias(c) for c in columns]).toDF(*[f"v{j}" for j in range(len(columns))]))
    names = numbers.columns
    index = rank_index(numbers, names, range_rows)
    # one row for each column
    seen = {r["column"]: r for r in index.groupBy("column").agg(F.count(F.lit(1)).alias("values"), *[F.sum(f"n{j}").alias(f"n{j}") for j in range(len(names))]).collect()}
    rows = numbers
    for j, c in enumerate(names):
        side = index.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("ranks").alias("avg_rank"), "n", F.lit(seen[c][f"n{j}"] if c in seen else 0).alias("total"))
        if c not in seen or seen[c]["values"] <= SMALL_SIDE_ROWS:
            rows = rows.join(F.broadcast(side.select(c, "avg_rank")), c, "left")
        else:
            found = attach_by_value(rows.filter(F.col(c).isNotNull()), side, [], c)
            rows = materialise(found.unionByName(rows.filter(F.col(c).isNull()), allowMissingColumns=True))
        rows = rows.withColumnRenamed("avg_rank", f"r{j}")
    at = {c: j for j, c in enumerate(columns)}
    aggregates, lines = [], []
    for k, (a, b) in enumerate(pairs):
        i, j = at[a], at[b]
        n = seen[names[i]][f"n{j}"] if names[i] in seen else 0
        both = F.col(f"r{i}").isNotNull() & F.col(f"r{j}").isNotNull()
        dx, dy = (F.when(both, F.col(f"r{x}")[y] - F.lit((n + 1) / 2.0)) for x, y in ((i, j), (j, i)))
        aggregates += [F.sum(dx * dy).alias(f"xy{k}"), F.sum(dx * dx).alias(f"xx{k}"), F.sum(dy * dy).alias(f"yy{k}")]
        lines.append(F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), F.lit(n).cast("long").alias("n_used"), *[F.col(f"{s}{k}").alias(s) for s in ("xy", "xx", "yy")]))
    sums = rows.agg(*aggregates).select(F.inline(F.array(*lines)))
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    enough = (F.col("n_used") >= min_complete) & (spread > 0)
    return sums.select("left_column", "right_column", "n_used", F.when(enough, F.col("xy") / spread).alias("spearman_rho"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation from its t form."""
    df = (n - 2).cast("double")
    return PV.p_t(r * F.sqrt(df / (1 - r * r)), df)


def numeric_associations(df: DataFrame, columns: Sequence[str], exclude: Iterable[tuple[str, str]] = ()) -> DataFrame:
    pairs = allowed_pairs(columns, exclude)
    joined = pearson(df, pairs).join(F.broadcast(spearman(df, pairs).drop("n_used")), ["left_column", "right_column"])
    return joined.select(
        "left_column", "right_column", "n_used", "pearson_r", correlation_p(F.col("pearson_r"), F.col("n_used")).alias("pearson_p_value"),
        "spearman_rho", correlation_p(F.col("spearman_rho"), F.col("n_used")).alias("spearman_p_value"),
        (F.col("n_used") >= LARGE_SAMPLE).alias("large_sample_warning"),
        F.when(F.col("pearson_r").isNull(), "skipped").otherwise("ok").alias("status"),
        F.when(F.col("pearson_r").isNull(), "insufficient_complete_cases").alias("skip_reason"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson", long: bool = False) -> DataFrame:
    """Symmetric matrix with one column per variable, or its long form (variable, other, r)."""
    pairs = list(combinations(columns, 2))
    found = pearson(df, pairs, 2) if method == "pearson" else spearman(df, pairs, 2)
    value = "pearson_r" if method == "pearson" else "spearman_rho"
    half = found.select(F.col("left_column").alias("variable"), F.col("right_column").alias("other"), F.col(value).alias("r"))
    mirrored = half.select(F.col("other").alias("variable"), F.col("variable").alias("other"), "r")
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "variable string, other string, r double")
    full = half.unionByName(mirrored).unionByName(diagonal)
    return full if long else full.groupBy("variable").agg(*[F.max(F.when(F.col("other") == c, F.col("r"))).alias(c) for c in columns])


def correlation_columns(profile: DataFrame, max_features: int = 20) -> list[str]:
    """Columns fit for a matrix from a numeric profile: 60 % filled, five levels, not 0/1 (one row per column)."""
    fit = profile.filter("null_pct <= 40 AND distinct_values >= 5 AND NOT is_binary_like").orderBy("column").limit(max_features)
    return [r["column"] for r in fit.select("column").collect()]

"""Inference plan: eligibility, intervals, group tests, associations and models of one table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import associate, groups, intervals, models
from assayer.session import materialise
from assayer.spec import MIN_NON_NULL_PCT, Spec


@dataclass(frozen=True)
class Analysis:
    """What to test. Columns of these lists are used where the data make them eligible; every eligible pair is tested."""

    outcomes: Sequence[str]
    grouping: Sequence[str]
    categorical: Sequence[str]
    numeric: Sequence[str]
    binary: Sequence[str] = ()
    same_by_construction: Iterable[tuple[str, str]] = ()
    excluded: Sequence[str] = ()
    linear_target: str | None = None
    logistic_target: str | None = None
    continuous_predictors: Sequence[str] = ()
    binary_predictors: Sequence[str] = ()
    categorical_predictors: Sequence[str] = ()
    top_n: int = 8
    min_size: int = 30
    options: dict = field(default_factory=dict)


def _diagnostics(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(analysis, subject, n_used, status, skip_reason) of all analyses in one table."""
    parts = [
        frame.select(
            F.lit(name).alias("analysis"), F.expr(subject).cast("string").alias("subject"), F.expr(used).cast("long").alias("n_used"),
            *([F.col("status"), F.col("skip_reason")] if "status" in frame.columns else [F.lit("ok").alias("status"), F.lit(None).cast("string").alias("skip_reason")]),
        )
        for name, (frame, subject, used) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def infer(df: DataFrame, spec: Spec, analysis: Analysis) -> dict[str, DataFrame]:
    """Result tables by name. The columns the tests read are written once.

    The candidate inventory decides which columns take part; columns it excludes are in it with their reason. Pairs that cannot
    be tested have rows with a skip reason. Pairwise comparisons follow overall tests with a difference only.
    """
    a = analysis
    inventory = materialise(intervals.candidates(df, spec, a.outcomes, a.grouping, a.excluded, a.top_n))
    fit = {r["column"]: r for r in inventory.collect()}  # one row for each column of the table

    def eligible(names: Sequence[str], rule: str) -> list[str]:
        return [c for c in names if fit[c][rule]]

    outcomes, grouping = eligible(a.outcomes, "eligible_group_outcome"), eligible(a.grouping, "eligible_group_var")
    categorical = [c for c in a.categorical if fit[c]["eligible_categorical_association"] or c not in a.grouping and fit[c]["nunique"] >= 2 and fit[c]["non_null_pct"] >= MIN_NON_NULL_PCT]
    numeric, means = eligible(a.numeric, "eligible_numeric_association"), eligible(a.numeric, "eligible_mean_ci")
    used = dict.fromkeys([
        *outcomes, *grouping, *categorical, *numeric, *a.binary, *a.continuous_predictors, *a.binary_predictors,
        *a.categorical_predictors, *[t for t in (a.linear_target, a.logistic_target) if t],
    ])
    rows = materialise(df.select(*used))
    results = {"candidate_inventory": inventory}
    seen: dict[str, tuple[DataFrame, str, str]] = {}
    if means:
        results["mean_intervals"] = intervals.mean_intervals(rows, means)
    if a.binary or categorical:
        results["proportion_intervals"] = intervals.proportion_intervals(rows, a.binary, categorical, a.top_n)
    if outcomes and grouping:
        pairs = list(product(outcomes, grouping))
        frame = groups.group_frame(rows, pairs, a.top_n, a.min_size)
        usable = materialise(groups.skip_reasons(rows, pairs, a.top_n, a.min_size))
        shared = groups.shared_ranks(frame, a.top_n + 1)
        assumed = materialise(groups.assumptions(frame, shared))
        compared = materialise(groups.compare(frame, assumed, a.top_n, shared))
        listed = usable.select("pair", "outcome_column", "group_column", "status", "skip_reason")
        results |= {
            "group_eligibility": usable, "assumptions": listed.select("pair", "status", "skip_reason").join(assumed, "pair", "left"),
            "group_comparisons": listed.join(compared, "pair", "left").join(groups.described(frame, shared), "pair", "left"),
            "posthoc": groups.posthoc(frame, assumed, compared), "posthoc_skipped": groups.too_many_levels(frame),
        }
        seen["group_comparison"] = (usable, "pair", "n_used")
    if len(categorical) > 1:
        results["categorical_associations"] = associate.associations(rows, associate.allowed_pairs(categorical), a.top_n, a.min_size)
        seen["categorical_association"] = (results["categorical_associations"], "concat_ws('|', left_column, right_column)", "n_used")
    if len(numeric) > 1:
        results["numeric_associations"] = associate.numeric_associations(rows, numeric, a.same_by_construction)
        results["correlation_matrix"] = associate.correlation_matrix(rows, numeric, "spearman")
        seen["numeric_association"] = (results["numeric_associations"], "concat_ws('|', left_column, right_column)", "n_used")
    predictors = (a.continuous_predictors, a.binary_predictors, a.categorical_predictors)
    for target, fit_model in ((a.linear_target, models.fit_linear), (a.logistic_target, models.fit_logistic)):
        if target:
            design = models.design_matrix(rows, target, *predictors, a.top_n, a.min_size)
            coefficients, diagnostics, _ = fit_model(design)
            name = fit_model.__name__.removeprefix("fit_")
            results[f"{name}_coefficients"], results[f"{name}_diagnostics"] = coefficients, diagnostics
            seen[f"{name}_model"] = (diagnostics, "target_column", "n_used")
    if seen:
        results["diagnostics"] = _diagnostics(seen)
    return results

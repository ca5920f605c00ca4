"""Design matrix, linear model and logistic model, fitted on the whole table by orthogonal factors."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import pvalues as PV
from assayer.functions.numbers import finite
from assayer.functions.text import normalize_text
from assayer.operators.factors import Step, independent, merged, solved, triangle
from assayer.operators.groups import OTHER
from assayer.operators.kernels import exact_quantiles, frequencies
from assayer.operators.lookups import sample_rows
from assayer.operators.profile import _top
from assayer.session import materialise
from assayer.spec import LARGE_SAMPLE

MIN_SPARE_ROWS = 10
MAX_STEPS = 60  # passes of a logistic fit
SMALL_STEP = 1e-8  # largest change of a row's log odds in a step of a finished fit
SEPARATING = 1e-5  # of the furthest row's move, to the wrong side


@dataclass(frozen=True)
class Design:
    """Matrix as a frame: the target, then one double column per term."""

    frame: DataFrame
    target: str
    terms: tuple[str, ...]
    skip_reason: str | None = None


def _kept_levels(df: DataFrame, categorical: Sequence[str], top_n: int, min_size: int) -> dict[str, set[str]]:
    """Levels kept per column: the ``top_n`` most frequent that also reach ``min_size`` (a short list per column)."""
    table = frequencies(df.select(*[normalize_text(F.col(c)).alias(c) for c in categorical]), categorical, keep_nulls=False)
    kept: dict[str, set[str]] = {c: set() for c in categorical}
    for row in _top(table, ["column"], top_n).filter(F.col("n") >= min_size).collect():
        kept[row["column"]].add(row["value"])
    return kept


def design_matrix(
    df: DataFrame, target: str, continuous: Sequence[str] = (), binary: Sequence[str] = (), categorical: Sequence[str] = (),
    top_n: int = 8, min_size: int = 30,
) -> Design:
    """Numbers as they are, categories as 0/1 columns without their first level, complete rows only.

    Rare and missing categories become ``Other``. Columns without variation are
    left out. Two small looks at the data (level counts, ranges) fix the columns; the
    needed columns are written once, as the looks and the fit all read them.
    """
    numbers = [c for c in (*continuous, *binary) if c != target]
    categorical = [c for c in categorical if c != target]
    df = materialise(df.select(target, *numbers, *categorical))
    kept = _kept_levels(df, categorical, top_n, min_size) if categorical else {}

    def level(name: str) -> Column:
        text = normalize_text(F.col(name))
        return F.when(text.isin(*kept[name]), text).otherwise(OTHER) if kept[name] else F.lit(OTHER)

    rows = df.select(
        finite(F.col(target)).alias(target), *[finite(F.col(c).cast("double")).alias(c) for c in numbers], *[level(c).alias(c) for c in categorical]
    ).dropna(subset=[target, *numbers])
    options = {c: sorted({*kept[c], OTHER}) for c in categorical}
    seen = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        *[(F.min(c) != F.max(c)).alias(f"v|{c}") for c in numbers],
        *[F.count_if(F.col(c) == x).alias(f"l|{c}|{x}") for c in categorical for x in options[c]],
    ).first()
    if not seen["rows"]:
        return Design(rows.select(target), target, (), "no_complete_cases")
    terms: dict[str, Column] = {c: F.col(c) for c in numbers if seen[f"v|{c}"]}
    for c in categorical:
        present = [x for x in options[c] if seen[f"l|{c}|{x}"]]
        terms |= {f"{c}_{x}": (F.col(c) == x).cast("double") for x in present[1:]}
    if not terms:
        return Design(rows.select(target), target, (), "predictors_lack_variability")
    return Design(rows.select(target, *[e.alias(n) for n, e in terms.items()]), target, tuple(terms))


def _limited(design: Design, max_rows: int | None, stratify: bool) -> DataFrame:
    """All rows unless the caller asks for a cap; the stratum column stays in the frame."""
    if max_rows is None:
        return design.frame
    return sample_rows(design.frame, max_rows, design.frame.columns, design.target if stratify else None)


_COEFFICIENTS = "term string, coefficient double, standard_error double, test_statistic double, p_value double, ci_lower double, ci_upper double"
_LINEAR = ("model_name string, target_column string, n_used long, n_terms long, r2 double, adj_r2 double, rmse double, mae double, "
           "aic double, bic double, large_sample_warning boolean, status string, skip_reason string, dropped_terms string")
_LOGISTIC = ("model_name string, target_column string, n_used long, n_terms long, accuracy double, brier double, aic double, "
             "large_sample_warning boolean, status string, skip_reason string, dropped_terms string")


def gaussian_criteria(n: int, rmse: float, k: int) -> tuple[float, float]:
    """AIC and BIC of a linear model from its residual spread; ``k`` counts the intercept."""
    deviance = n * (math.log(2 * math.pi) + 2 * math.log(rmse) + 1)
    return deviance + 2 * k, deviance + k * math.log(n)


def _plain(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (target, terms) as (constant, terms, target), with the number of rows."""
    return np.column_stack([np.ones(len(row)), row[:, 1:], row[:, 0]]), np.array([float(len(row))]), np.zeros(1)


def _positional(frame: DataFrame) -> DataFrame:
    """The target as ``y`` and the terms as ``x1``, ``x2``, ...: their names need no quoting."""
    return frame.toDF("y", *[f"x{i}" for i in range(1, len(frame.columns))])


def _linear(coefficients: Sequence[float]) -> Column:
    """Constant and terms of a row with these coefficients."""
    total = F.lit(float(coefficients[0]))
    for i, c in enumerate(coefficients[1:], 1):
        total = total + F.lit(float(c)) * F.col(f"x{i}")
    return total


def dependent_terms(data: DataFrame, terms: Sequence[str]) -> list[str]:
    """Terms that are linear combinations of the constant and the terms before them; one pass over ``data`` (target, terms)."""
    factor, _, _ = triangle(_positional(data), _plain, 2 + len(terms))
    kept = independent(factor[:, :-1])
    return [t for j, t in enumerate(terms, 1) if j not in kept]


def fit_linear(design: Design, singular: str = "drop") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Least squares over all rows by merged orthogonal factors. Returns coefficients, diagnostics and (fitted, residual) rows.

    ``singular``: "drop" leaves out terms that others determine and names them in the diagnostics; "minimum_norm" keeps all terms and
    takes the solution of least norm, as a pseudo-inverse does. One pass makes the factor, a second the absolute error. A perfect
    fit has no standard errors to divide by: its test statistics and criteria are null.
    """
    if singular not in ("drop", "minimum_norm"):
        raise ValueError("singular must be 'drop' or 'minimum_norm'")
    spark = design.frame.sparkSession

    def skipped(n: int, reason: str):
        row = ("linear_regression", design.target, n, 1 + len(design.terms), *[None] * 6, False, "skipped", reason, None)
        return spark.createDataFrame([], _COEFFICIENTS), spark.createDataFrame([row], _LINEAR), None

    if design.skip_reason:
        return skipped(0, design.skip_reason)
    data = materialise(_positional(design.frame))
    whole, sums, _ = triangle(data, _plain, 2 + len(design.terms))
    n = int(sums[0]) if len(sums) else 0
    if n <= 1 + len(design.terms) + MIN_SPARE_ROWS:
        return skipped(n, "insufficient_rows_for_model")
    kept = independent(whole[:, :-1])
    dropped = [t for j, t in enumerate(design.terms, 1) if j not in kept]
    if len(kept) < 2:
        return skipped(n, "singular_design")
    used = kept if singular == "drop" else list(range(1 + len(design.terms)))
    terms = [("const", *design.terms)[j] for j in used]
    factor = merged([whole[:, [*used, whole.shape[1] - 1]]], len(used) + 1)
    estimates, variances, rank = solved(factor[:-1, :-1], factor[:-1, -1])
    rest = factor[:, -1] - factor[:, :-1] @ estimates
    lost = float(rest @ rest)
    constant = factor[:, 0] / np.linalg.norm(factor[:, 0])
    about_mean = factor[:, -1] - constant * (constant @ factor[:, -1])
    total = float(about_mean @ about_mean)
    if lost <= 1e-26 * total:
        lost = 0.0
    free = n - rank
    critical = PV.t_quantile(0.975, free)
    rows = []
    for term, estimate, error in zip(terms, map(float, estimates), map(float, np.sqrt(variances * lost / free)), strict=True):
        t = estimate / error if error > 0 else None
        p = PV.t_two_sided(t, free) if t is not None else None
        rows.append((term, estimate, error, t, p, estimate - critical * error, estimate + critical * error))
    rmse = math.sqrt(lost / n)
    aic, bic = gaussian_criteria(n, rmse, rank) if rmse > 0 else (None, None)
    r2 = 1 - lost / total if total > 0 else None
    every = np.zeros(1 + len(design.terms))
    every[used] = estimates
    fitted = data.select(_linear(every).alias("fitted"), (F.col("y") - _linear(every)).alias("residual"))
    mae = fitted.agg(F.avg(F.abs("residual"))).first()[0]
    diagnostics = (
        "linear_regression", design.target, n, len(terms), r2, 1 - (1 - r2) * (n - 1) / free if r2 is not None else None, rmse, mae,
        aic, bic, n >= LARGE_SAMPLE, "ok", None, ", ".join(dropped) or None,
    )
    return spark.createDataFrame(rows, _COEFFICIENTS), spark.createDataFrame([diagnostics], _LINEAR), fitted


def _newton(coefficients: np.ndarray, direction: np.ndarray) -> Step:
    """Rows of the weighted least squares that give the next step of a logistic fit.

    Sums: rows, positives, log-likelihood, right answers at one half, squared gaps. Peaks along ``direction``: the furthest that a row
    moves to the wrong side of its class, the furthest that any row moves.
    """

    def step(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        y, x = row[:, 0], np.column_stack([np.ones(len(row)), row[:, 1:]])
        eta = x @ coefficients
        mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        weight = np.maximum(mu * (1 - mu), 1e-12)
        root = np.sqrt(weight)
        moved = (2 * y - 1) * (x @ direction)
        likelihood = -np.logaddexp(0, -(2 * y - 1) * eta).sum()
        sums = np.array([len(y), y.sum(), likelihood, ((mu >= 0.5) == (y > 0.5)).sum(), ((mu - y) ** 2).sum()], float)
        return np.column_stack([x * root[:, None], (y - mu) / root]), sums, np.array([(-moved).max(), np.abs(moved).max()])

    return step


def fit_logistic(design: Design, max_rows: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Logistic fit by reweighted least squares. Returns coefficients with odds ratios, diagnostics, and (probability, observed) rows.

    Each step is one pass that gives an orthogonal factor of the weighted rows. Terms that others determine are dropped and named.
    If the fit's last step moves no row to the wrong side of its class and some to the right one, no finite coefficients are best:
    the classes are separated, the status says so, the terms of that step are named, and there are no coefficients or odds ratios.

    ``max_rows``: bound of a reproducible sample, proportional by class, that the classifier is fitted on; by default all rows.
    """
    spark = design.frame.sparkSession
    terms = ("const", *design.terms)
    columns = _COEFFICIENTS + ", odds_ratio double, odds_ratio_ci_lower double, odds_ratio_ci_upper double"
    dropped: list[str] = []

    def without(n: int, status: str, reason: str):
        row = ("logistic_regression", design.target, n, len(terms), None, None, None, False, status, reason, ", ".join(dropped) or None)
        return spark.createDataFrame([], columns), spark.createDataFrame([row], _LOGISTIC), None

    if design.skip_reason:
        return without(0, "skipped", design.skip_reason)
    data = materialise(_positional(_limited(design, max_rows, True)))
    width = 1 + len(terms)
    whole, sums, _ = triangle(data, _plain, width)
    n = int(sums[0]) if len(sums) else 0
    if data.agg(F.count_distinct("y")).first()[0] < 2:
        return without(n, "skipped", "target_has_single_class")
    if n <= len(terms) + MIN_SPARE_ROWS:
        return without(n, "skipped", "insufficient_rows_for_model")
    kept = independent(whole[:, :-1])
    dropped = [terms[j] for j in range(1, len(terms)) if j not in kept]
    data, terms, width = data.select("y", *[f"x{j}" for j in kept[1:]]), tuple(terms[j] for j in kept), 1 + len(kept)
    data = _positional(data)
    at, move, before = np.zeros(len(terms)), np.zeros(len(terms)), -math.inf
    for turn in range(MAX_STEPS):
        factor, sums, (wrong, far) = triangle(data, _newton(at, move), width)
        if sums[2] < before - 1e-9 * abs(before) and turn:  # too far: half the step
            move = move / 2
            at = at - move
            continue
        if turn and far < SMALL_STEP:
            break
        if turn >= 3 and wrong <= SEPARATING * far:
            scale = np.abs(move) * np.sqrt((factor[:-1, :-1] ** 2).sum(axis=0))
            named = [t for t, s in zip(terms, scale, strict=True) if t != "const" and s > 1e-6 * scale.max()]
            return without(n, "separated", "classes_separated_by: " + ", ".join(named))
        before = sums[2]
        move, variances, _ = solved(factor[:-1, :-1], factor[:-1, -1])
        at = at + move
    else:
        return without(n, "not_converged", f"no_convergence_in_{MAX_STEPS}_steps")
    _, variances, _ = solved(factor[:-1, :-1], factor[:-1, -1])
    z95 = PV.normal_quantile(0.975)
    rows = []
    for term, estimate, error in zip(terms, map(float, at), map(float, np.sqrt(variances)), strict=True):
        z, low, high = estimate / error if error > 0 else None, estimate - z95 * error, estimate + z95 * error
        rows.append((term, estimate, error, z, PV.normal_two_sided(z) if z is not None else None, low, high, _exp(estimate), _exp(low), _exp(high)))
    predicted = data.select((1 / (1 + F.exp(-_linear(at)))).alias("probability"), F.col("y").alias("observed"))
    diagnostics = (
        "logistic_regression", design.target, n, len(terms), float(sums[3]) / n, float(sums[4]) / n, 2 * len(terms) - 2 * float(sums[2]),
        n >= LARGE_SAMPLE, "ok", None, ", ".join(dropped) or None,
    )
    return spark.createDataFrame(rows, columns), spark.createDataFrame([diagnostics], _LOGISTIC), predicted


def _exp(x: float) -> float:
    return math.exp(x) if x < 700 else math.inf


def residual_bins(fitted: DataFrame, bins: int = 41) -> DataFrame:
    """Rows per cell of fitted value and residual, both cut in ``bins`` equal parts of their range: the residual plot of all rows."""
    ends = fitted.agg(*[f(c).alias(f"{c}_{n}") for c in ("fitted", "residual") for n, f in (("low", F.min), ("high", F.max))])
    placed = fitted.join(F.broadcast(ends))  # one row

    def part(name: str) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(high > low, F.least(F.lit(bins), F.floor((F.col(name) - low) / (high - low) * bins) + 1)).otherwise(F.lit(1)).cast("long")

    return placed.groupBy(part("fitted").alias("fitted_bin"), part("residual").alias("residual_bin")).agg(F.count(F.lit(1)).alias("n"))


def residual_quantiles(fitted: DataFrame, steps: int = 20) -> DataFrame:
    """Exact quantiles of the residuals of all rows beside those of the normal distribution."""
    probs = {f"q{i}": i / steps for i in range(1, steps)}
    found = exact_quantiles(fitted, ["residual"], probs)
    rows = F.array(*[F.struct(F.lit(p).alias("probability"), F.col(q).alias("residual"), F.lit(PV.normal_quantile(p)).alias("normal_quantile")) for q, p in probs.items()])
    return found.select(F.inline(rows))

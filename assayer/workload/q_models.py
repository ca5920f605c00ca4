"""Design matrix and models (M), residual points (V8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import models as M
from assayer.operators.intervals import Z95
from assayer.plans.score import score
from assayer.workload.fixtures import SPEC, processes, with_p
from assayer.workload.registry import query

_STATES = ("O", "P")
_MODES = ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _design(spark, sf):
    rows = processes(spark, sf, "base_price", "n_lines", "duration", "url", "state", "mode").withColumn("with_url", F.col("url").isNotNull().cast("int"))
    return M.design_matrix(rows, "base_price", ["n_lines", "duration"], ["with_url"], ["state", "mode"])


@query("design_matrix", with_p(f"""
SELECT base_price, CAST(n_lines AS DOUBLE) AS n_lines, duration, CAST(url IS NOT NULL AS DOUBLE) AS with_url,
  {', '.join(f'''CAST(state = '{s}' AS DOUBLE) AS "state_{s}"''' for s in _STATES)},
  {', '.join(f'''CAST(mode = '{m}' AS DOUBLE) AS "mode_{m}"''' for m in _MODES)}
FROM P WHERE base_price IS NOT NULL AND n_lines IS NOT NULL AND duration IS NOT NULL"""), "base_price duration")
def _(spark, sf):
    return _design(spark, sf).frame


@query("ols_fit", with_p("""
SELECT 'n_lines' AS term, slope AS coefficient, se AS standard_error, slope / se AS test_statistic, r2, n AS n_used FROM (
  SELECT regr_slope(base_price, n_lines) AS slope, regr_r2(base_price, n_lines) AS r2, regr_count(base_price, n_lines) AS n,
    sqrt(regr_syy(base_price, n_lines) * (1 - regr_r2(base_price, n_lines)) / (regr_count(base_price, n_lines) - 2) / regr_sxx(base_price, n_lines)) AS se FROM P)"""),
       "coefficient standard_error test_statistic r2")
def _(spark, sf):
    design = M.design_matrix(processes(spark, sf, "base_price", "n_lines"), "base_price", ["n_lines"])
    coefficients, diagnostics, _ = M.fit_linear(design)
    slope = coefficients.filter("term <> 'const'").select("term", "coefficient", "standard_error", "test_statistic")
    return slope.withColumns({"r2": diagnostics.select("r2").scalar(), "n_used": diagnostics.select("n_used").scalar()})


_TWO = ("n_lines", "n_suppliers")


@query("ols_two_predictors", with_p("""
SELECT unnest(['const', 'n_lines', 'n_suppliers']) AS term, unnest([my - b1 * m1 - b2 * m2, b1, b2]) AS coefficient,
  unnest([sqrt(s2 * (1 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / det)), sqrt(s2 * s22 / det), sqrt(s2 * s11 / det)]) AS standard_error
FROM (SELECT *, (syy - b1 * s1y - b2 * s2y) / (n - 3) AS s2 FROM (SELECT *, (s22 * s1y - s12 * s2y) / det AS b1, (s11 * s2y - s12 * s1y) / det AS b2
  FROM (SELECT *, s11 * s22 - s12 * s12 AS det FROM (
    SELECT CAST(count(*) AS DOUBLE) AS n, avg(base_price) AS my, avg(n_lines) AS m1, avg(n_suppliers) AS m2,
      count(*) * var_pop(base_price) AS syy, count(*) * var_pop(n_lines) AS s11, count(*) * var_pop(n_suppliers) AS s22,
      count(*) * covar_pop(n_lines, n_suppliers) AS s12, count(*) * covar_pop(n_lines, base_price) AS s1y, count(*) * covar_pop(n_suppliers, base_price) AS s2y
    FROM P WHERE base_price IS NOT NULL AND n_lines IS NOT NULL AND n_suppliers IS NOT NULL))))"""), "coefficient standard_error")
def _(spark, sf):
    design = M.design_matrix(processes(spark, sf, "base_price", *_TWO), "base_price", _TWO)
    return M.fit_linear(design)[0].select("term", "coefficient", "standard_error")


@query("ols_coefficients")
def _(spark, sf):
    return M.fit_linear(_design(spark, sf))[0]


@query("ols_diagnostics")
def _(spark, sf):
    return M.fit_linear(_design(spark, sf))[1]


def _risk_design(spark, sf):
    rows = score(processes(spark, sf), SPEC)
    return M.design_matrix(rows, "low_quality_risk", ["description_length", "duration"], ["flag_has_portfolio"], ["mode"])


@query("logistic_fit")
def _(spark, sf):
    return M.fit_logistic(_risk_design(spark, sf))[0]


def _odds_sql(z: str = repr(Z95)) -> str:
    """A logistic fit on one 0/1 term in closed form: the cells of its two-by-two table."""
    return f"""
SELECT unnest(['const', 'with_url']) AS term, unnest([ln(c / d), ln(a * d / (b * c))]) AS coefficient,
  unnest([sqrt(1 / c + 1 / d), sqrt(1 / a + 1 / b + 1 / c + 1 / d)]) AS standard_error, unnest([c / d, a * d / (b * c)]) AS odds_ratio,
  unnest([c / d * exp(-{z} * sqrt(1 / c + 1 / d)), a * d / (b * c) * exp(-{z} * sqrt(1 / a + 1 / b + 1 / c + 1 / d))]) AS odds_ratio_ci_lower
FROM (SELECT CAST(count(*) FILTER (u AND h) AS DOUBLE) AS a, CAST(count(*) FILTER (u AND NOT h) AS DOUBLE) AS b,
    CAST(count(*) FILTER (NOT u AND h) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT u AND NOT h) AS DOUBLE) AS d
  FROM (SELECT url IS NOT NULL AS u, n_lines > 4 AS h FROM P WHERE n_lines IS NOT NULL))"""


def _flag_design(spark, sf):
    rows = processes(spark, sf, "url", "n_lines").select(F.col("url").isNotNull().cast("int").alias("with_url"), (F.col("n_lines") > 4).cast("int").alias("many_lines"))
    return M.design_matrix(rows, "many_lines", binary=["with_url"])


@query("logistic_odds", with_p(_odds_sql()), "coefficient standard_error odds_ratio odds_ratio_ci_lower")
def _(spark, sf):
    return M.fit_logistic(_flag_design(spark, sf))[0].select("term", "coefficient", "standard_error", "odds_ratio", "odds_ratio_ci_lower")


@query("logistic_diagnostics")
def _(spark, sf):
    return M.fit_logistic(_risk_design(spark, sf))[1]


_RESIDUALS = """RS AS (SELECT a + s * n_lines AS fitted, base_price - (a + s * n_lines) AS residual FROM P,
  (SELECT regr_slope(base_price, n_lines) AS s, regr_intercept(base_price, n_lines) AS a FROM P) WHERE base_price IS NOT NULL AND n_lines IS NOT NULL)"""


def _one_predictor(spark, sf):
    return M.fit_linear(M.design_matrix(processes(spark, sf, "base_price", "n_lines"), "base_price", ["n_lines"]))[2]


@query("residual_data", with_p("""
SELECT fitted_bin, residual_bin, count(*) AS n FROM (
  SELECT CAST(least(41, floor((fitted - fl) / (fh - fl) * 41) + 1) AS BIGINT) AS fitted_bin, CAST(least(41, floor((residual - rl) / (rh - rl) * 41) + 1) AS BIGINT) AS residual_bin
  FROM RS, (SELECT min(fitted) AS fl, max(fitted) AS fh, min(residual) AS rl, max(residual) AS rh FROM RS)) GROUP BY 1, 2""", _RESIDUALS))
def _(spark, sf):
    return M.residual_bins(_one_predictor(spark, sf))


_PROBABILITIES = [i / 20 for i in range(1, 20)]


@query("residual_quantiles", with_p(f"""
SELECT p AS probability, r AS residual FROM (
  SELECT unnest(CAST({_PROBABILITIES} AS DOUBLE[])) AS p, unnest(quantile_cont(residual, {_PROBABILITIES})) AS r FROM RS)""", _RESIDUALS), "probability residual")
def _(spark, sf):
    return M.residual_quantiles(_one_predictor(spark, sf)).drop("normal_quantile")


@query("residual_data_full")
def _(spark, sf):
    return M.residual_bins(M.fit_linear(_design(spark, sf))[2])


@query("residual_quantiles_full")
def _(spark, sf):
    return M.residual_quantiles(M.fit_linear(_design(spark, sf))[2])

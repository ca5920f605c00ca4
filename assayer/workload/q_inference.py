"""Eligibility, intervals, group tests and associations (I), covariance (X5), interval bars (V7)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from assayer.operators import associate as S
from assayer.operators import groups as G
from assayer.operators import intervals as I
from assayer.operators import lookups as L
from assayer.operators import plotdata
from assayer.workload.fixtures import P_COLUMNS, SPEC, processes, with_p
from assayer.workload.q_profiles import sql_pct, union
from assayer.workload.q_rows import sql_text
from assayer.workload.registry import query

NUMBERS = ("base_price", "duration", "n_lines", "n_suppliers")
FLAGS_CTE = "PF AS (SELECT *, CAST(url IS NOT NULL AS INT) AS with_url, CAST(tags IS NOT NULL AS INT) AS with_tags FROM P)"
LABELS = {"segment": sql_text("segment"), "with_url": "CAST(with_url AS VARCHAR)", "with_tags": "CAST(with_tags AS VARCHAR)"}
Z = repr(I.Z95)


def flagged(spark, sf, *columns):
    rows = processes(spark, sf, *dict.fromkeys((*columns, "url", "tags")))
    return rows.withColumns({"with_url": F.col("url").isNotNull().cast("int"), "with_tags": F.col("tags").isNotNull().cast("int")})


def frame_sql(pairs, top_n: int = 8, min_size: int = 30) -> str:
    parts = []
    for o, g in pairs:
        label = LABELS.get(g, g)
        rows = f"(SELECT {label} AS g, CAST({o} AS DOUBLE) AS v FROM PF WHERE {o} IS NOT NULL AND {label} IS NOT NULL)"
        top = f"(SELECT g FROM {rows} GROUP BY 1 ORDER BY count(*) DESC, g LIMIT {top_n})"
        parts.append(f"SELECT '{o}|{g}' AS pair, CASE WHEN g IN {top} THEN g ELSE 'Other' END AS level, v AS value FROM {rows}")
    return f"""F0 AS ({' UNION ALL '.join(parts)}),
FR AS (SELECT * FROM F0 WHERE (pair, level) IN (SELECT (pair, level) FROM F0 GROUP BY pair, level HAVING count(*) >= {min_size}))"""


def framed(body: str, pairs, *ctes: str) -> str:
    return with_p(body, FLAGS_CTE, frame_sql(pairs), *ctes)


def frame(spark, sf, pairs, **options):
    columns = [c for p in pairs for c in p if c in P_COLUMNS]
    return G.group_frame(flagged(spark, sf, *columns), pairs, **options)


PAIRS = [("base_price", "mode"), ("base_price", "nation"), ("n_lines", "segment"), ("base_price", "state"), ("duration", "with_url")]
TWO = [("base_price", "with_url"), ("n_lines", "with_tags"), ("duration", "with_url")]
FEW = [("base_price", "state"), ("n_lines", "mode"), ("n_suppliers", "state")]


# -- eligibility and intervals ----------------------------------------------

_OUTCOMES, _GROUPS, _EXCLUDED = ("base_price", "n_lines"), ("mode", "segment", "nation"), ("state", "effective")
_KINDS = {
    "proc_key": "numeric", "proc_id": "technical", "ref_id": "technical", "url": "technical", "description": "text", "category_code": "categorical",
    "state": "categorical", "mode": "categorical", "published": "datetime", "received": "datetime", "opened": "datetime", "effective": "datetime",
    "base_price": "numeric", "segment": "categorical", "nation": "categorical", "tags": "categorical", "duration": "numeric",
    "duration_unit": "categorical", "n_lines": "numeric", "n_suppliers": "numeric", "n_returned": "numeric", "n_discounted": "numeric",
}


def _bool(x: bool) -> str:
    return "TRUE" if x else "FALSE"


_CANDIDATES = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{k}' AS semantic_group, count({c}) AS non_null_count, {sql_pct(f'(count(*) - count({c}))', 'count(*)')} AS null_pct,
  count(DISTINCT {c}) AS nunique, {_bool(c in _OUTCOMES)} AS o, {_bool(c in _GROUPS)} AS g, {_bool(c in _EXCLUDED)} AS model_excluded FROM P""" for c, k in _KINDS.items()
)


@query("candidate_inventory", with_p(f"""
SELECT "column", semantic_group, non_null_count, round(100 - null_pct, 4) AS non_null_pct, null_pct, nunique, FALSE AS is_binary_like,
  num AS eligible_mean_ci, semantic_group = 'categorical' AND filled AND nunique BETWEEN 2 AND 32 AS eligible_proportion_ci, o AND num AS eligible_group_outcome,
  g AND cat AS eligible_group_var, g AND cat AS eligible_categorical_association, num AS eligible_numeric_association,
  NOT model_excluded AND (num OR cat) AS eligible_predictor, model_excluded,
  CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, ' | ') ELSE 'eligible' END AS skip_reason
FROM (SELECT *, semantic_group = 'numeric' AND filled AND nunique >= 5 AS num, semantic_group = 'categorical' AND filled AND nunique >= 2 AS cat,
    list_filter([CASE WHEN semantic_group IN ('text', 'technical') THEN 'technical_or_text_column' END, CASE WHEN NOT filled THEN 'low_completeness' END,
      CASE WHEN semantic_group = 'numeric' AND nunique < 5 THEN 'low_numeric_variability' END,
      CASE WHEN semantic_group = 'categorical' AND nunique < 2 THEN 'single_level' END,
      CASE WHEN model_excluded THEN 'excluded_from_modeling' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT *, round(100 - null_pct, 4) >= 60 AS filled FROM ({_CANDIDATES})))"""), "non_null_pct null_pct")
def _(spark, sf):
    return I.candidates(processes(spark, sf), SPEC, _OUTCOMES, _GROUPS, _EXCLUDED).drop("dtype")


@query("mean_ci_stats", with_p(union("""SELECT '{c}' AS "column", count({c}) AS n_used, avg({c}) AS estimate,
  stddev_samp({c}) / sqrt(count({c})) AS standard_error FROM P""", NUMBERS)), "estimate standard_error")
def _(spark, sf):
    return I.mean_stats(processes(spark, sf, *NUMBERS), NUMBERS)


@query("mean_ci")
def _(spark, sf):
    return I.mean_intervals(processes(spark, sf, *NUMBERS), NUMBERS)


_WILSON_CATEGORIES = ("mode", "nation", "state")


def _wilson_sql() -> str:
    parts = [f"""SELECT '{c}' AS "column", 'positive' AS category, count(*) FILTER ({c} > 0) AS successes, count({c}) AS n_used FROM PF""" for c in ("with_url", "with_tags")]
    parts += [f"""SELECT '{c}', CASE WHEN {c} IN (SELECT {c} FROM P WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) THEN {c} ELSE 'Other' END,
  count(*), (SELECT count({c}) FROM P) FROM PF WHERE {c} IS NOT NULL GROUP BY 2""" for c in _WILSON_CATEGORIES]
    return "W AS (" + " UNION ALL ".join(parts) + f"""),
WI AS (SELECT "column", category, successes, n_used, p AS estimate, sqrt(p * (1 - p) / n) AS standard_error, (centre - margin) AS ci_lower, (centre + margin) AS ci_upper
  FROM (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS centre, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS margin
    FROM (SELECT *, CAST(n_used AS DOUBLE) AS n, CAST(successes AS DOUBLE) / n_used AS p, CAST({Z} AS DOUBLE) AS z FROM W)))"""


def _wilson(spark, sf):
    return I.proportion_intervals(flagged(spark, sf, *_WILSON_CATEGORIES), ["with_url", "with_tags"], _WILSON_CATEGORIES)


@query("wilson_ci", with_p("SELECT * FROM WI", FLAGS_CTE, _wilson_sql()), "estimate standard_error ci_lower ci_upper")
def _(spark, sf):
    return _wilson(spark, sf)


@query("ci_plot_data", with_p("""SELECT row_number() OVER (ORDER BY estimate, "column", category) AS rank, "column", category, estimate, greatest(0.0, estimate - ci_lower) AS distance_below, greatest(0.0, ci_upper - estimate) AS distance_above
FROM WI""", FLAGS_CTE, _wilson_sql()), "estimate distance_below distance_above")
def _(spark, sf):
    return plotdata.ci_bars(_wilson(spark, sf), ("column", "category"))


# -- group tests ------------------------------------------------------------


@query("group_frame", framed("SELECT pair, level, value, count(*) AS n FROM FR GROUP BY ALL", PAIRS), "value")
def _(spark, sf):
    return frame(spark, sf, PAIRS, reused=False).groupBy("pair", "level", "value").agg(F.count(F.lit(1)).alias("n"))


_RARE = [*PAIRS, ("base_price", "tags")]
_LISTED = ", ".join(f"('{o}|{g}', '{o}', '{g}')" for o, g in _RARE)


@query("group_eligibility", with_p(f"""
SELECT l.pair, outcome_column, group_column, coalesce(n_used, 0) AS n_used, coalesce(n_groups, 0) AS n_groups,
  CASE WHEN n_complete IS NULL OR n_groups IS NULL THEN 'skipped' ELSE 'ok' END AS status,
  CASE WHEN n_complete IS NULL THEN 'no_complete_cases' WHEN n_groups IS NULL THEN 'insufficient_valid_groups' END AS skip_reason
FROM (VALUES {_LISTED}) l(pair, outcome_column, group_column)
LEFT JOIN (SELECT pair, count(*) AS n_complete FROM F0 GROUP BY pair) c ON l.pair = c.pair
LEFT JOIN (SELECT pair, CAST(sum(n) AS BIGINT) AS n_used, count(*) AS n_groups FROM (SELECT pair, level, count(*) AS n FROM FR GROUP BY pair, level)
  GROUP BY pair HAVING count(*) >= 2) u ON l.pair = u.pair""", FLAGS_CTE, frame_sql(_RARE)))
def _(spark, sf):
    rare = _RARE
    return G.skip_reasons(flagged(spark, sf, "base_price", "n_lines", "duration", "mode", "nation", "segment", "state"), rare)


_MOMENTS = "MO AS (SELECT pair, level, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM FR GROUP BY pair, level)"


def _anova_ctes(source: str) -> str:
    return f"""T AS (SELECT pair, count(DISTINCT level) AS k, count(*) AS n_total, avg(value) AS grand FROM {source} GROUP BY pair),
SQ AS (SELECT m.pair, any_value(k) AS k, any_value(n_total) AS n_total, sum(n * (mean - grand) * (mean - grand)) AS between_ss, sum((n - 1) * var) AS within_ss
  FROM (SELECT pair, level, count(*) AS n, avg(value) AS mean, var_samp(value) AS var FROM {source} GROUP BY pair, level) m JOIN T ON m.pair = T.pair GROUP BY m.pair)"""


@query("anova_f", framed("""SELECT pair, k AS n_groups, n_total AS n_used, (between_ss / (k - 1)) / (within_ss / (n_total - k)) AS f, k - 1 AS df_between,
  n_total - k AS df_within, between_ss / (between_ss + within_ss) AS eta_squared FROM SQ""", PAIRS, _anova_ctes("FR")), "f eta_squared")
def _(spark, sf):
    return G.anova(frame(spark, sf, PAIRS, reused=False))


_SPREAD = """MD AS (SELECT pair, level, quantile_cont(value, 0.5) AS median FROM FR GROUP BY pair, level),
LV AS (SELECT FR.pair, FR.level, abs(value - median) AS value FROM FR JOIN MD ON FR.pair = MD.pair AND FR.level = MD.level)"""


@query("levene_stat", framed("""SELECT pair, k AS n_groups, n_total AS n_used, (between_ss / (k - 1)) / (within_ss / (n_total - k)) AS w, k - 1 AS df_between,
  n_total - k AS df_within FROM SQ""", PAIRS, _SPREAD, _anova_ctes("LV")), "w")
def _(spark, sf):
    return G.levene(frame(spark, sf, PAIRS))


@query("welch_t", framed("""
SELECT pair, left_group, right_group, n_left, n_right, (ma - mb) / sqrt(ea + eb) AS t,
  (ea + eb) * (ea + eb) / (ea * ea / (n_left - 1) + eb * eb / (n_right - 1)) AS df,
  (ma - mb) / sqrt(((n_left - 1) * va + (n_right - 1) * vb) / (n_left + n_right - 2)) AS cohens_d
FROM (SELECT a.pair, a.level AS left_group, b.level AS right_group, a.n AS n_left, b.n AS n_right, a.mean AS ma, b.mean AS mb, a.var AS va, b.var AS vb,
        a.var / a.n AS ea, b.var / b.n AS eb FROM MO a JOIN MO b ON a.pair = b.pair AND a.level < b.level)""", [*TWO, *FEW], _MOMENTS), "t df cohens_d")
def _(spark, sf):
    return G.welch(frame(spark, sf, [*TWO, *FEW], reused=False))


_U_CTES = """LP AS (SELECT DISTINCT a.pair, a.level AS l, b.level AS r FROM (SELECT DISTINCT pair, level FROM FR) a JOIN (SELECT DISTINCT pair, level FROM FR) b
  ON a.pair = b.pair AND a.level < b.level),
UR AS (SELECT LP.pair, l, r, FR.level, value, rank() OVER (PARTITION BY LP.pair, l, r ORDER BY value) + (count(*) OVER (PARTITION BY LP.pair, l, r, value) - 1) / CAST(2 AS DOUBLE) AS rk,
    count(*) OVER (PARTITION BY LP.pair, l, r, value) AS t FROM LP JOIN FR ON FR.pair = LP.pair AND (FR.level = l OR FR.level = r)),
US AS (SELECT pair, l, r, count(*) FILTER (level = l) AS n_left, count(*) FILTER (level = r) AS n_right, sum(rk) FILTER (level = l) AS r1,
    sum((CAST(t AS DOUBLE) * t * t - t) / t) AS ties FROM UR GROUP BY pair, l, r),
UU AS (SELECT *, r1 - n_left * (n_left + 1) / CAST(2 AS DOUBLE) AS u, CAST(n_left AS DOUBLE) * n_right AS ab, CAST(n_left + n_right AS DOUBLE) AS nn FROM US)"""
_U_SELECT = """SELECT pair, l AS left_group, r AS right_group, n_left, n_right, u,
  (greatest(u, ab - u) - ab / 2 - 0.5) / sqrt(ab / 12 * (nn + 1 - ties / (nn * (nn - 1)))) AS z, 2 * u / ab - 1 AS rank_biserial FROM UU"""


@query("mann_whitney", framed(_U_SELECT, TWO, _U_CTES), "u z rank_biserial")
def _(spark, sf):
    return G.mann_whitney(frame(spark, sf, TWO), 2)


@query("posthoc_pairwise", framed(_U_SELECT, FEW, _U_CTES), "u z rank_biserial")
def _(spark, sf):
    return G.mann_whitney(frame(spark, sf, FEW), G.MAX_POSTHOC_GROUPS)


@query("posthoc_holm")
def _(spark, sf):
    return G.posthoc(frame(spark, sf, FEW))


@query("kruskal_h", framed("""
SELECT pair, n AS n_used, k AS n_groups, h, k - 1 AS df, (h - k + 1) / (n - k) AS epsilon_squared
FROM (SELECT a.pair, n, k, (12.0::DOUBLE / (n * (n + 1.0::DOUBLE)) * s - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS h
  FROM (SELECT pair, count(*) AS k, sum(rs * rs / m) AS s FROM (SELECT pair, level, sum(rk) AS rs, count(*) AS m FROM R GROUP BY 1, 2) GROUP BY pair) a
  JOIN (SELECT pair, count(*) AS n, sum((CAST(t AS DOUBLE) * t * t - t) / t) AS ties FROM R GROUP BY pair) b ON a.pair = b.pair)""", PAIRS,
    """R AS (SELECT pair, level, value, rank() OVER (PARTITION BY pair ORDER BY value) + (count(*) OVER (PARTITION BY pair, value) - 1) / CAST(2 AS DOUBLE) AS rk,
         count(*) OVER (PARTITION BY pair, value) AS t FROM FR)"""), "h epsilon_squared")
def _(spark, sf):
    return G.kruskal(frame(spark, sf, PAIRS))


_K2 = """KS AS (SELECT pair, level, CAST(count(*) AS DOUBLE) AS n, count(*) AS c, var_pop(value) AS spread, kurtosis_pop(value) + 3 AS b2,
    skewness(value) * (count(*) - 2) / sqrt(CAST(count(*) AS DOUBLE) * (count(*) - 1)) AS g1 FROM FR GROUP BY pair, level),
KA AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
    sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w,
    (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS q FROM KS),
KB AS (SELECT *, y / sqrt(2 / (w - 1)) AS s, 6 + 8 / q * (2 / q + sqrt(1 + 4 / (q * q))) AS a FROM KA),
KC AS (SELECT *, 1 / sqrt(0.5::DOUBLE * ln(w)) * ln(s + sqrt(s * s + 1)) AS z1, 1 + x * sqrt(2 / (a - 4)) AS u FROM KB),
KD AS (SELECT *, (1 - 2 / (9 * a) - sign(u) * cbrt((1 - 2 / a) / abs(u))) / sqrt(2 / (9 * a)) AS z2 FROM KC)"""


@query("normality", framed("SELECT pair, level, c AS n, z1 * z1 + z2 * z2 AS k2, exp(-(z1 * z1 + z2 * z2) / 2) AS p_value FROM KD", PAIRS, _K2), "k2 p_value")
def _(spark, sf):
    return G.normality(frame(spark, sf, PAIRS, reused=False))


@query("shapiro")
def _(spark, sf):
    return G.shapiro(frame(spark, sf, PAIRS))


@query("assumption_checks")
def _(spark, sf):
    return G.assumptions(frame(spark, sf, PAIRS))


@query("group_comparisons")
def _(spark, sf):
    rows = frame(spark, sf, PAIRS)
    shared = G.shared_ranks(rows)
    return G.compare(rows, G.assumptions(rows, shared), shared=shared).join(G.described(rows, shared), "pair", "left")


@query("holm_adjust", with_p("""
SELECT segment, mode, p_value, least(1.0::DOUBLE, max(h) OVER (PARTITION BY segment ORDER BY p_value, mode)) AS holm_adjusted_p_value,
  least(1.0::DOUBLE, max(h) OVER (PARTITION BY segment ORDER BY p_value, mode)) < 0.05 AS significant_after_holm
FROM (SELECT *, (count(*) OVER (PARTITION BY segment) - row_number() OVER (PARTITION BY segment ORDER BY p_value, mode) + 1) * p_value AS h
  FROM (SELECT segment, mode, exp(-(n - e) * (n - e) / e / 2) AS p_value FROM (
    SELECT segment, mode, n, sum(n) OVER (PARTITION BY segment) * sum(n) OVER (PARTITION BY mode) / CAST(sum(n) OVER () AS DOUBLE) AS e
    FROM (SELECT segment, mode, count(*) AS n FROM P GROUP BY 1, 2))))"""), "p_value holm_adjusted_p_value")
def _(spark, sf):
    # Tail of a chi-square with two degrees of freedom, which has a closed form.
    cells = processes(spark, sf, "segment", "mode").groupBy("segment", "mode").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupBy("segment").agg(F.sum("n").alias("row_n"))
    columns = cells.groupBy("mode").agg(F.sum("n").alias("col_n"))
    total = cells.agg(F.sum("n")).scalar()
    joined = cells.join(rows, "segment").join(columns, "mode").withColumn("e", F.col("row_n") * F.col("col_n") / total.cast("double"))
    gap = F.col("n") - F.col("e")
    return L.holm(joined.select("segment", "mode", F.exp(-gap * gap / F.col("e") / 2).alias("p_value")), "p_value", ["segment"], ["mode"])


# -- associations -----------------------------------------------------------

CATEGORY_PAIRS = [("mode", "state"), ("segment", "nation"), ("state", "with_url"), ("with_url", "with_tags"), ("category_code", "mode")]


def cells_sql(pairs, top_n: int = 8, min_size: int = 30) -> str:
    parts = []
    for a, b in pairs:
        la, lb = LABELS.get(a, a), LABELS.get(b, b)
        rows = f"(SELECT {la} AS l, {lb} AS r FROM PF WHERE {la} IS NOT NULL AND {lb} IS NOT NULL)"
        sides = ", ".join(
            f"CASE WHEN {x} IN (SELECT {x} FROM {rows} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {top_n}) THEN {x} ELSE 'Other' END AS {x}" for x in "lr"
        )
        parts.append(f"SELECT '{a}|{b}' AS pair, {sides} FROM {rows}")
    return f"""C0 AS ({' UNION ALL '.join(parts)}),
CE AS (SELECT pair, l AS left_level, r AS right_level, count(*) AS n FROM C0
  WHERE (pair, l) IN (SELECT (pair, l) FROM C0 GROUP BY pair, l HAVING count(*) >= {min_size})
    AND (pair, r) IN (SELECT (pair, r) FROM C0 GROUP BY pair, r HAVING count(*) >= {min_size}) GROUP BY ALL)"""


def cells(spark, sf, pairs):
    columns = [c for p in pairs for c in p if c in P_COLUMNS]
    return S.pair_cells(flagged(spark, sf, *columns), pairs)


@query("pair_frame", with_p("SELECT * FROM CE", FLAGS_CTE, cells_sql(CATEGORY_PAIRS)))
def _(spark, sf):
    return cells(spark, sf, CATEGORY_PAIRS)


@query("chi_square", with_p("""
SELECT pair, CAST(total AS BIGINT) AS n_used, nr || 'x' || nc AS table_shape, chi2, dof, sqrt(chi2 / (total * (least(nr, nc) - 1))) AS cramers_v, below AS expected_below_5_pct
FROM (SELECT pair, any_value(total) AS total, any_value(nr) AS nr, any_value(nc) AS nc, any_value(dof) AS dof,
    sum((CASE WHEN dof = 1 THEN gap - least(0.5::DOUBLE, gap) ELSE gap END) ** 2 / e) AS chi2, count(*) FILTER (e < 5) * 100.0::DOUBLE / count(*) AS below
  FROM (SELECT g.*, abs(coalesce(CE.n, 0) - e) AS gap FROM (
    SELECT a.pair, left_level, right_level, total, nr, nc, (nr - 1) * (nc - 1) AS dof, CAST(row_n AS DOUBLE) * col_n / total AS e
    FROM (SELECT pair, left_level, sum(n) AS row_n FROM CE GROUP BY 1, 2) a
    JOIN (SELECT pair, right_level, sum(n) AS col_n FROM CE GROUP BY 1, 2) b ON a.pair = b.pair
    JOIN (SELECT pair, sum(n) AS total, count(DISTINCT left_level) AS nr, count(DISTINCT right_level) AS nc FROM CE GROUP BY 1) t ON a.pair = t.pair) g
  LEFT JOIN CE ON CE.pair = g.pair AND CE.left_level = g.left_level AND CE.right_level = g.right_level) GROUP BY pair)""", FLAGS_CTE, cells_sql(CATEGORY_PAIRS)),
       "chi2 cramers_v expected_below_5_pct")
def _(spark, sf):
    return S.chi_square(cells(spark, sf, CATEGORY_PAIRS))


@query("fisher_exact")
def _(spark, sf):
    return S.fisher(cells(spark, sf, CATEGORY_PAIRS))


@query("categorical_associations")
def _(spark, sf):
    columns = ("mode", "state", "segment", "nation", "category_code")
    return S.associations(flagged(spark, sf, *columns), S.allowed_pairs([*columns, "with_url", "with_tags"]))


_NUMERIC_PAIRS = list(combinations(NUMBERS, 2))


def _pairs_sql(template: str, pairs) -> str:
    return "\nUNION ALL\n".join(template.replace("{a}", a).replace("{b}", b) for a, b in pairs)


@query("pearson_pairs", with_p(_pairs_sql("""SELECT '{a}' AS left_column, '{b}' AS right_column, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n_used,
  corr({a}, {b}) AS pearson_r FROM P""", _NUMERIC_PAIRS)), "pearson_r")
def _(spark, sf):
    return S.pearson(processes(spark, sf, *NUMBERS), _NUMERIC_PAIRS)


_RHO = """SELECT '{a}' AS left_column, '{b}' AS right_column, count(*) AS n_used, corr(rx, ry) AS spearman_rho FROM (
  SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / CAST(2 AS DOUBLE) AS rx,
    rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / CAST(2 AS DOUBLE) AS ry FROM P WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@query("spearman_pairs", with_p(_pairs_sql(_RHO, _NUMERIC_PAIRS)), "spearman_rho")
def _(spark, sf):
    return S.spearman(processes(spark, sf, *NUMBERS), _NUMERIC_PAIRS)


@query("numeric_associations")
def _(spark, sf):
    return S.numeric_associations(processes(spark, sf, *NUMBERS), NUMBERS, [("n_lines", "n_suppliers")])


_MATRIX = ("base_price", "duration", "n_lines", "n_suppliers", "n_returned")


@query("correlation_matrix", with_p(union("SELECT '{c}' AS variable, " + ", ".join(f"CASE WHEN '{{c}}' = '{m}' THEN 1 ELSE corr({{c}}, {m}) END AS {m}" for m in _MATRIX) + " FROM P", _MATRIX)), " ".join(_MATRIX))
def _(spark, sf):
    return S.correlation_matrix(processes(spark, sf, *_MATRIX), _MATRIX)


@query("spearman_matrix", with_p(_pairs_sql(_RHO.replace("left_column", "variable").replace("right_column", "other").replace("count(*) AS n_used, ", "").replace("AS spearman_rho", "AS r"),
    [(a, b) for a in NUMBERS[:3] for b in NUMBERS[:3] if a != b]) + "\nUNION ALL SELECT c, c, 1 FROM (SELECT unnest(['base_price', 'duration', 'n_lines']) AS c)"), "r")
def _(spark, sf):
    return S.correlation_matrix(processes(spark, sf, *NUMBERS[:3]), NUMBERS[:3], "spearman", long=True)


@query("covariance_matrix", with_p(_pairs_sql("""SELECT '{a}' AS left_column, '{b}' AS right_column, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n_used,
  covar_samp({a}, {b}) AS covariance FROM P""", [*_NUMERIC_PAIRS, *[(c, c) for c in NUMBERS]])), "covariance")
def _(spark, sf):
    return S.covariance(processes(spark, sf, *NUMBERS), NUMBERS)


@query("top_correlations", with_p("SELECT * FROM (" + _pairs_sql("""SELECT '{a}' AS left_column, '{b}' AS right_column,
  count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n_used, corr({a}, {b}) AS pearson_r FROM P""", _NUMERIC_PAIRS) + ") ORDER BY abs(pearson_r) DESC LIMIT 4"), "pearson_r")
def _(spark, sf):
    return S.top_correlations(processes(spark, sf, *NUMBERS), NUMBERS, 4)

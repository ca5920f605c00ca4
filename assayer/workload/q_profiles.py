"""Profiles (A), melts and cross-tabs, plot data built on them (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import columns as C
from assayer.operators import dedup, derive, plotdata, sketches
from assayer.operators import profile as A
from assayer.operators.kernels import frequencies
from assayer.session import materialise
from assayer.spec import PLACEHOLDER_TOKENS
from assayer.workload.fixtures import P_COLUMNS, SPEC, documents, duplicated, processes, table, with_p, with_pd
from assayer.workload.q_rows import FLAGS, INDICATORS_CTE, indicators, scored, sql_days, sql_list, sql_token, stamp, with_scores
from assayer.workload.registry import query

TEXT_COLUMNS = ("url", "description", "category_code", "state", "mode", "segment", "nation", "tags", "duration_unit")
CATEGORIES = ("mode", "state", "segment", "nation", "duration_unit", "tags")
NUMBERS = ("base_price", "duration", "n_lines", "n_suppliers", "n_returned")


def union(template: str, names) -> str:
    """The same SELECT for several columns, united; ``{c}`` is the column."""
    return "\nUNION ALL\n".join(template.replace("{c}", c) for c in names)


def sql_pct(part: str, whole: str) -> str:
    return f"round({part} * CAST(100 AS DOUBLE) / {whole}, 4)"


@query("null_profile", with_p(union(f"""SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS null_count,
  {sql_pct('(count(*) - count({c}))', 'count(*)')} AS null_pct, count({{c}}) AS non_null_count,
  {sql_pct('count({c})', 'count(*)')} AS completeness_pct FROM P""", P_COLUMNS)), "null_pct completeness_pct")
def _(spark, sf):
    return A.null_profile(processes(spark, sf))


_TOKENS = sql_list(PLACEHOLDER_TOKENS)


@query("expanded_nulls", with_p(union(f"""SELECT '{{c}}' AS "column", {sql_pct('count(*) FILTER ({c} IS NULL)', 'count(*)')} AS null_pct,
  {sql_pct(f"count(*) FILTER ({{c}} IS NULL OR {sql_token('{c}')} IN ({_TOKENS}))", 'count(*)')} AS expanded_null_pct FROM P""", TEXT_COLUMNS)),
       "null_pct expanded_null_pct")
def _(spark, sf):
    return A.expanded_nulls(processes(spark, sf, *TEXT_COLUMNS))


@query("placeholder_counts", with_p("SELECT * FROM (" + union(
    f"""SELECT '{{c}}' AS "column", count(*) FILTER ({sql_token('{c}')} IN ({_TOKENS})) AS placeholders FROM P""", TEXT_COLUMNS
) + ") WHERE placeholders > 0"))
def _(spark, sf):
    return A.placeholder_counts(processes(spark, sf, *TEXT_COLUMNS))


@query("cardinality", with_p(union("""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_values,
  count(DISTINCT {c}) + CAST(max(CAST({c} IS NULL AS INT)) AS BIGINT) AS distinct_with_null FROM P""", P_COLUMNS)))
def _(spark, sf):
    return A.cardinality(processes(spark, sf))


_LOWVAR = ("mode", "state", "segment", "nation", "tags", "duration_unit", "category_code", "description", "n_lines")


@query("low_variability", with_p(union("""
SELECT '{c}' AS "column", count(*) AS distinct_with_null, count(v) AS distinct_values, first(v ORDER BY n DESC, v NULLS LAST) AS dominant_value,
  round(max(n) * CAST(100 AS DOUBLE) / sum(n), 4) AS dominant_share_pct, max(n) * CAST(100 AS DOUBLE) / sum(n) >= 95 AS is_near_constant,
  count(*) <= 1 AS is_constant, count(v) <= 1 AND count(v) > 0 AS is_single_value
FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM P GROUP BY 1)""", _LOWVAR)), "dominant_share_pct")
def _(spark, sf):
    return A.low_variability(processes(spark, sf, *_LOWVAR))


@query("exact_duplicates", with_pd("""
SELECT (SELECT count(*) FROM PD) AS "rows", (SELECT count(*) FROM PD) - count(*) AS duplicate_rows,
  round(((SELECT count(*) FROM PD) - count(*)) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM PD), 4) AS duplicate_pct
FROM (SELECT DISTINCT * FROM PD)"""), "duplicate_pct")
def _(spark, sf):
    return dedup.exact_duplicate_count(duplicated(spark, sf))


def _key_dups(filtered: bool) -> str:
    parts = []
    for key in (("proc_id",), ("ref_id",), ("proc_id", "ref_id"), ("category_code", "nation")):
        where = " AND ".join(f"{k} IS NOT NULL" for k in key) if filtered else "TRUE"
        parts.append(f"""SELECT '{', '.join(key)}' AS key_columns, CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_rows, count(*) AS duplicate_keys,
  round(coalesce(sum(c), 0) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM PD), 4) AS duplicate_pct
FROM (SELECT count(*) AS c FROM PD WHERE {where} GROUP BY {', '.join(key)} HAVING count(*) > 1)""")
    return with_pd("\nUNION ALL\n".join(parts))


_KEYS = [["proc_id"], ["ref_id"], ["proc_id", "ref_id"], ["category_code", "nation"]]


@query("key_duplicates", _key_dups(False), "duplicate_pct")
def _(spark, sf):
    return dedup.duplicate_summary(duplicated(spark, sf, "proc_id", "ref_id", "category_code", "nation"), _KEYS)


@query("key_duplicates_nonnull", _key_dups(True), "duplicate_pct")
def _(spark, sf):
    return dedup.duplicate_summary(duplicated(spark, sf, "proc_id", "ref_id", "category_code", "nation"), _KEYS, null_keys=False)


_Q = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


@query("numeric_profile", with_p(union(f"""
SELECT '{{c}}' AS "column", count(v) AS non_null_count, count(*) - count(v) AS null_count, {sql_pct('(count(*) - count(v))', 'count(*)')} AS null_pct,
  count(DISTINCT v) AS distinct_values, bool_and(v IN (0, 1)) AS is_binary_like, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min,
  {', '.join(f'any_value({n}) AS {n}' for n in _Q)}, max(v) AS max, any_value(p75 - p25) AS iqr,
  any_value(p25 - 1.5 * (p75 - p25)) AS lower_fence, any_value(p75 + 1.5 * (p75 - p25)) AS upper_fence,
  count(*) FILTER (v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25)) AS outlier_count,
  {sql_pct('count(*) FILTER (v < p25 - 1.5 * (p75 - p25) OR v > p75 + 1.5 * (p75 - p25))', 'count(v)')} AS outlier_pct,
  count(*) FILTER (v = 0) AS zero_count, {sql_pct('count(*) FILTER (v = 0)', 'count(v)')} AS zero_pct
FROM (SELECT CAST({{c}} AS DOUBLE) AS v FROM P)
CROSS JOIN (SELECT {', '.join(f'quantile_cont(CAST({{c}} AS DOUBLE), {q}) AS {n}' for n, q in _Q.items())} FROM P)""", NUMBERS)),
       "null_pct mean std min p01 p05 p25 p50 p75 p95 p99 max iqr lower_fence upper_fence outlier_pct zero_pct")
def _(spark, sf):
    return A.numeric_profile(processes(spark, sf, *NUMBERS), NUMBERS)


@query("categorical_profile", with_p(union(f"""
SELECT '{{c}}' AS "column", CAST(sum(n) FILTER (v IS NOT NULL) AS BIGINT) AS non_null_count, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_count,
  {sql_pct('coalesce(sum(n) FILTER (v IS NULL), 0)', 'sum(n)')} AS null_pct, count(v) AS distinct_values,
  first(v ORDER BY n DESC, v NULLS LAST) AS top_category, max(n) AS top_count, {sql_pct('max(n)', 'sum(n)')} AS top_share_pct,
  count(*) FILTER (n < 0.01::DOUBLE * (SELECT count(*) FROM P)) AS rare_categories,
  (SELECT string_agg(coalesce(v, 'null'), ', ' ORDER BY n DESC, v NULLS LAST) FROM (
     SELECT {{c}} AS v, count(*) AS n FROM P GROUP BY 1 ORDER BY n DESC, v NULLS LAST LIMIT 5)) AS preview
FROM (SELECT {{c}} AS v, count(*) AS n FROM P GROUP BY 1)""", CATEGORIES)), "null_pct top_share_pct")
def _(spark, sf):
    return A.categorical_profile(processes(spark, sf, *CATEGORIES), CATEGORIES)


@query("frequency_table", with_p(union(f"""
SELECT '{{c}}' AS "column", {{c}} AS category, count(*) AS count, {sql_pct('count(*)', '(SELECT count(*) FROM P)')} AS relative_pct
FROM P GROUP BY 2""", CATEGORIES)), "relative_pct")
def _(spark, sf):
    return A.frequency_table(processes(spark, sf, *CATEGORIES), CATEGORIES)


_MOMENTS = ("published", "received", "opened", "effective")


@query("datetime_profile", with_p(union(f"""
SELECT '{{c}}' AS "column", count({{c}}) AS non_null_count, count(*) - count({{c}}) AS null_count, {sql_pct('(count(*) - count({c}))', 'count(*)')} AS null_pct,
  strftime(min({{c}}), '%Y-%m-%d %H:%M:%S') AS min_datetime, strftime(max({{c}}), '%Y-%m-%d %H:%M:%S') AS max_datetime,
  CAST(min(year({{c}})) AS INT) AS min_year, CAST(max(year({{c}})) AS INT) AS max_year, count(DISTINCT year({{c}})) AS distinct_years,
  (SELECT CAST(y AS INT) FROM (SELECT year({{c}}) AS y, count(*) AS n FROM P WHERE {{c}} IS NOT NULL GROUP BY 1 ORDER BY n DESC, y LIMIT 1)) AS modal_year,
  (SELECT m FROM (SELECT strftime({{c}}, '%Y-%m') AS m, count(*) AS n FROM P WHERE {{c}} IS NOT NULL GROUP BY 1 ORDER BY n DESC, m LIMIT 1)) AS modal_month
FROM P""", _MOMENTS)), "null_pct")
def _(spark, sf):
    profile = A.datetime_profile(processes(spark, sf, *_MOMENTS), _MOMENTS)
    return profile.select(*[stamp(c) if c in ("min_datetime", "max_datetime") else c for c in profile.columns])


def _periods(fmt: str) -> str:
    return with_p(union(f"""SELECT '{{c}}' AS "column", strftime({{c}}, '{fmt}') AS period, count(*) AS count FROM P
WHERE {{c}} IS NOT NULL GROUP BY 2""", _MOMENTS))


@query("year_counts", _periods("%Y"))
def _(spark, sf):
    return A.period_counts(processes(spark, sf, *_MOMENTS), _MOMENTS, "yyyy")


@query("month_counts", _periods("%Y-%m"))
def _(spark, sf):
    return A.period_counts(processes(spark, sf, *_MOMENTS), _MOMENTS, "yyyy-MM")


@query("text_quality", union(f"""
SELECT '{{c}}' AS "column", count({{c}}) AS non_null_count, count(*) - count({{c}}) AS null_count,
  {sql_pct("count(*) FILTER (trim(coalesce({c}, '')) = '')", 'count(*)')} AS blank_pct,
  {sql_pct("count(*) FILTER (length(coalesce({c}, '')) < 10)", 'count(*)')} AS short_pct,
  round(avg(length(coalesce({{c}}, ''))), 4) AS mean_length,
  round(quantile_cont(CAST(length(coalesce({{c}}, '')) AS DOUBLE), 0.5), 4) AS median_length,
  round(quantile_cont(CAST(length(coalesce({{c}}, '')) AS DOUBLE), 0.95), 4) AS p95_length, max(length(coalesce({{c}}, ''))) AS max_length
FROM (SELECT *, CASE WHEN quality = 1 THEN text END AS kept_text FROM documents LEFT JOIN labels USING (doc_id))""", ("text", "source", "kept_text")),
       "blank_pct short_pct mean_length median_length p95_length")
def _(spark, sf):
    docs = documents(spark, sf).withColumn("kept_text", F.when(F.col("quality") == 1, F.col("text")))
    return A.text_quality(docs, ["text", "source", "kept_text"])


_DAYS = ("days_to_receipt", "days_to_opening", "process_days")
_DAYS_CTE = f"""
M AS (SELECT *, {sql_days('published', 'received')} AS days_to_receipt, {sql_days('published', 'opened')} AS days_to_opening,
        {sql_days('published', 'coalesce(effective, opened, received)')} AS process_days FROM P)"""


def _with_days(spark, sf, *extra):
    rows = processes(spark, sf, *dict.fromkeys((*extra, *_MOMENTS)))
    return rows.withColumns(derive.day_metrics(SPEC))


@query("temporal_summary", with_p(
    union("""SELECT '{c}' AS "column", 'datetime' AS kind, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
  strftime(min({c}), '%Y-%m-%d %H:%M:%S') AS min, strftime(max({c}), '%Y-%m-%d %H:%M:%S') AS max, CAST(NULL AS DOUBLE) AS mean,
  CAST(NULL AS DOUBLE) AS median FROM M""", _MOMENTS) + "\nUNION ALL\n" +
    union("""SELECT '{c}', 'days', count({c}), count(*) - count({c}), CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR), avg({c}),
  quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM M""", _DAYS), _DAYS_CTE), "mean median")
def _(spark, sf):
    return A.temporal_summary(_with_days(spark, sf), _MOMENTS, _DAYS)


_PROFILED = ("score_completeness", "score_traceability", "score_temporal", "score_competition", "quality_score", "evidence_coverage")
_LABELS = ("risk_level", "label_confidence")
_BINARY = ("low_quality_risk", "flag_useful_description", "flag_public_url", "flag_minimal_competition")


@query("score_profile", with_scores(
    union("""SELECT '{c}' AS "column", 'numeric' AS profile_type, count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
  CAST(0 AS DOUBLE) AS null_pct, avg({c}) AS mean, quantile_cont({c}, 0.5) AS median, min({c}) AS min, quantile_cont({c}, 0.25) AS p25,
  quantile_cont({c}, 0.75) AS p75, max({c}) AS max, CAST(NULL AS VARCHAR) AS top_category, CAST(NULL AS DOUBLE) AS top_share_pct,
  CAST(NULL AS DOUBLE) AS positive_rate_pct FROM E8""", _PROFILED) + "\nUNION ALL\n" +
    union("""SELECT '{c}', 'categorical', CAST(sum(n) AS BIGINT), 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, first(v ORDER BY n DESC, v),
  round(max(n) * CAST(100 AS DOUBLE) / sum(n), 4), NULL FROM (SELECT {c} AS v, count(*) AS n FROM E8 GROUP BY 1)""", _LABELS) + "\nUNION ALL\n" +
    union("""SELECT '{c}', 'binary_indicator', count({c}), 0, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  round(count(*) FILTER ({c} > 0) * CAST(100 AS DOUBLE) / count(*), 4) FROM E8""", _BINARY)),
       "null_pct mean median min p25 p75 max top_share_pct positive_rate_pct")
def _(spark, sf):
    return A.score_profile(scored(spark, sf), _PROFILED, _LABELS, _BINARY)


_ENTITY = ("ind_url", "ind_description", "ind_price", "ind_keys", "ind_states", "ind_competition", "ind_temporal", "temporal_anomaly")


@query("entity_quality", with_p(f"""
SELECT ref_id, nation, state, segment, count(proc_id) AS processes, round(avg(record_completeness) * 100 + 1e-9, 4) AS mean_completeness_pct,
  {', '.join(f'round(avg(CAST({c} AS INT)) * 100 + 1e-9, 4) AS {c}_pct' for c in _ENTITY)}
FROM IND GROUP BY ref_id, nation, state, segment""", INDICATORS_CTE),
       "mean_completeness_pct " + " ".join(f"{c}_pct" for c in _ENTITY))
def _(spark, sf):
    return A.entity_rollup(indicators(spark, sf), ("ref_id", "nation", "state", "segment"), "proc_id", "record_completeness", _ENTITY)


@query("numeric_by_category", with_p("""
SELECT mode, count(*) AS n, avg(base_price) AS mean, quantile_cont(base_price, 0.5) AS median, stddev_samp(base_price) AS std,
  min(base_price) AS min, max(base_price) AS max FROM P WHERE base_price IS NOT NULL AND mode IS NOT NULL GROUP BY mode"""),
       "mean median std min max")
def _(spark, sf):
    return A.numeric_by_group(processes(spark, sf, "mode", "base_price"), "base_price", "mode")


@query("group_stats", with_p("""
SELECT nation, count(*) AS n, avg(n_lines) AS mean, quantile_cont(CAST(n_lines AS DOUBLE), 0.5) AS median,
  CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(n_lines) END AS std, min(n_lines) AS min, max(n_lines) AS max
FROM P WHERE n_lines IS NOT NULL GROUP BY nation"""), "mean median std")
def _(spark, sf):
    return A.numeric_by_group(processes(spark, sf, "nation", "n_lines"), "n_lines", "nation", keep_null_group=True)


@query("rate_by_category", with_p("""
SELECT mode, count(*) AS n, round(avg(CAST(coalesce(n_lines, 0) > 1 AS INT)) * 100 + 1e-9, 4) AS rate_pct FROM P GROUP BY mode"""), "rate_pct")
def _(spark, sf):
    rows = processes(spark, sf, "mode", "n_lines").withColumn("reported", F.coalesce(F.col("n_lines"), F.lit(0)) > 1)
    return A.rate_by_group(rows, "reported", "mode")


@query("median_by_state", with_p(f"""
SELECT nation, {', '.join(f'quantile_cont(CAST({c} AS DOUBLE), 0.5) AS {c}' for c in _DAYS)} FROM M GROUP BY nation""", _DAYS_CTE), " ".join(_DAYS))
def _(spark, sf):
    return A.medians_by_group(_with_days(spark, sf, "nation"), _DAYS, "nation")


@query("melt_metrics", with_p(union(
    "SELECT proc_id, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM M WHERE {c} IS NOT NULL", _DAYS), _DAYS_CTE), "value")
def _(spark, sf):
    return A.melt(_with_days(spark, sf, "proc_id"), "proc_id", _DAYS)


@query("crosstab", with_p("""
SELECT nation, count(*) FILTER (state = 'F') AS F, count(*) FILTER (state = 'O') AS O, count(*) FILTER (state NOT IN ('F', 'O')) AS other
FROM P WHERE nation IN (SELECT nation FROM P WHERE nation IS NOT NULL AND state IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, nation LIMIT 15)
  AND state IS NOT NULL GROUP BY nation"""))
def _(spark, sf):
    return A.crosstab(processes(spark, sf, "nation", "state"), "nation", "state", ["F", "O"], top_index=15)


@query("mode_value", with_p(union("""SELECT * FROM (SELECT '{c}' AS "column", {c} AS mode_value, count(*) AS mode_count FROM P WHERE {c} IS NOT NULL
  GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1)""", CATEGORIES)))
def _(spark, sf):
    return A.mode_value(processes(spark, sf, *CATEGORIES), CATEGORIES)


@query("dataset_overview", with_pd(f"""
SELECT (SELECT count(*) FROM PD) AS n_rows, {len(P_COLUMNS)} AS n_columns, (SELECT count(*) FROM PD) - (SELECT count(*) FROM (SELECT DISTINCT * FROM PD)) AS exact_duplicate_rows,
  count(DISTINCT proc_id) AS proc_id_unique, count(DISTINCT ref_id) AS ref_id_unique, 4 AS n_datetime_columns, 7 AS n_numeric_columns, 0 AS n_binary_numeric_columns,
  0 AS n_boolean_columns, 7 AS n_categorical_columns, 1 AS n_text_columns, 3 AS n_technical_columns FROM PD"""))
def _(spark, sf):
    rows = duplicated(spark, sf)
    return A.overview(rows, ["proc_id", "ref_id"], C.group_sizes(rows, SPEC))


@query("column_inventory", with_p(union(f"""SELECT '{{c}}' AS "column", count({{c}}) AS non_null_count, count(*) - count({{c}}) AS null_count,
  {sql_pct('(count(*) - count({c}))', 'count(*)')} AS null_pct, count(DISTINCT {{c}}) AS distinct_values FROM P""", P_COLUMNS)), "null_pct")
def _(spark, sf):
    return C.inventory(processes(spark, sf), SPEC).select("column", "non_null_count", "null_count", "null_pct", "distinct_values")


def _inventory_sql() -> str:
    from assayer.workload.q_columns import group_sql  # q_columns builds on this module

    roles = C.role_names(SPEC)
    rows = [
        f"""SELECT g.*, '{' | '.join(roles.get(c, [])) or 'none'}' AS roles, {'TRUE' if c in roles else 'FALSE'} AS has_role, n.* FROM ({group_sql(c, i, 'P')}) g,
  (SELECT count({c}) AS non_null_count, count(*) - count({c}) AS null_count, {sql_pct(f'(count(*) - count({c}))', 'count(*)')} AS null_pct, count(DISTINCT {c}) AS distinct_values FROM P) n"""
        for i, c in enumerate(P_COLUMNS, 1)
    ]
    return with_p("\nUNION ALL\n".join(rows))


@query("column_inventory_full", deferred=_inventory_sql, doubles="null_pct")
def _(spark, sf):
    return C.inventory(processes(spark, sf), SPEC)


# -- plot data --------------------------------------------------------------


@query("histogram", with_p("""
SELECT bin, count(*) AS n, lo + (bin - 1) * (hi - lo) / 40 AS bin_start, lo + bin * (hi - lo) / 40 AS bin_end
FROM (SELECT least(40, CAST(floor((base_price - lo) / (hi - lo) * 40) AS BIGINT) + 1) AS bin, lo, hi
      FROM P, (SELECT min(base_price) AS lo, max(base_price) AS hi FROM P)) GROUP BY bin, lo, hi"""), "bin_start bin_end")
def _(spark, sf):
    return plotdata.histogram(processes(spark, sf, "base_price"), "base_price", 40)


@query("boxplot_stats", with_p("""
SELECT coalesce(mode, 'all') AS mode, count(*) AS n, any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3,
  min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
FROM (SELECT D.mode, D.base_price AS v, Q.q1, Q.q2, Q.q3 FROM D JOIN Q ON D.mode = Q.mode) GROUP BY mode""",
    "D AS (SELECT mode, base_price FROM P WHERE base_price IS NOT NULL UNION ALL SELECT 'all', base_price FROM P WHERE base_price IS NOT NULL)",
    """Q AS (SELECT mode, quantile_cont(base_price, 0.25) AS q1, quantile_cont(base_price, 0.5) AS q2, quantile_cont(base_price, 0.75) AS q3
       FROM D GROUP BY mode)"""), "q1 median q3 whisker_low whisker_high")
def _(spark, sf):
    return plotdata.boxplot(processes(spark, sf, "mode", "base_price"), "base_price", "mode")


@query("sketch_profile")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    stored = materialise(sketches.sketches(orders, ["month"], ["o_custkey", "o_orderstatus", "o_orderpriority"], ["o_totalprice"]))
    return sketches.sketch_profile(stored)

"""Text, number and date functions, derivations, scores, deduplication, the two row pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import numbers as N
from assayer.functions import text as X
from assayer.operators import dedup, derive
from assayer.operators.audit import cleaning_audit
from assayer.operators.columns import ROLE_RULES, column_role
from assayer.operators.kernels import exact_quantiles, sized_side
from assayer.operators.score import add_labels, add_scores, engineer_flags
from assayer.plans.clean import clean
from assayer.plans.score import score
from assayer.spec import (
    COMPETITION_WEIGHTS,
    COMPLETENESS_WEIGHTS,
    PLACEHOLDER_TOKENS,
    SCORING_PLACEHOLDER,
    TEMPORAL_WEIGHTS,
    TOTAL_WEIGHTS,
    TRACEABILITY_WEIGHTS,
)
from assayer.workload.fixtures import P_COLUMNS, SPEC, documents, duplicated, events, processes, table, with_p, with_pd
from assayer.workload.registry import query

WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
STAMP = "%Y-%m-%d %H:%M:%S"


def stamp(name: str):
    return F.date_format(F.col(name).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(name)


def sql_text(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '{WS}', ' ', 'g')), '')"


def sql_token(x: str) -> str:
    folded = rf"regexp_replace(strip_accents(lower({sql_text(x)})), '[^\x00-\x7F]', '', 'g')"
    return f"nullif(trim(regexp_replace({folded}, '{WS}', ' ', 'g')), '')"


def sql_list(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def sql_canonical(x: str) -> str:
    return f"CASE WHEN {sql_token(x)} IN ({sql_list(t for t in PLACEHOLDER_TOKENS if t)}) THEN NULL ELSE {sql_text(x)} END"


def sql_placeholder(x: str) -> str:
    return f"regexp_matches(lower(trim(coalesce({x}, ''))), '{SCORING_PLACEHOLDER}')"


def sql_micros_days(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / CAST(86400000000 AS DOUBLE))"


def sql_days(start: str, end: str) -> str:
    return f"CAST(floor({sql_micros_days(start, end)}) AS BIGINT)"


# -- functions --------------------------------------------------------------


@query("normalize_text", f"""
SELECT doc_id, {sql_text('text')} AS clean, coalesce(length({sql_text('text')}), 0) AS clean_chars FROM documents""")
def _(spark, sf):
    clean = X.normalize_text(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", clean.alias("clean"), F.coalesce(F.length(clean), F.lit(0)).cast("long").alias("clean_chars")
    )


@query("normalize_text_nfkc")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text"), nfkc=True).alias("clean"))


@query("normalize_token", f"SELECT doc_id, lang, {sql_token('text')} AS token FROM documents")
def _(spark, sf):
    return X.with_tokens(table(spark, sf, "documents").select("doc_id", "lang", "text"), {"token": F.col("text")}).drop("text")


_SEG_TOKEN = sql_token("segment")


@query("canonicalize_text", with_p(f"""
SELECT proc_key, {sql_canonical('segment')} AS plain,
  CASE WHEN {_SEG_TOKEN} = 'no aplica' THEN 'NO_APLICA' WHEN {_SEG_TOKEN} = 'no definido' THEN NULL
       ELSE {sql_text('segment')} END AS kept,
  CASE WHEN {_SEG_TOKEN} IN ('no aplica', 'no definido') THEN 'SIN_DATO' ELSE {sql_text('segment')} END AS labelled,
  CASE WHEN {sql_token('duration_unit')} = 'no especificado' THEN 'UNIDAD_DESCONOCIDA'
       ELSE {sql_text('duration_unit')} END AS unit
FROM P"""))
def _(spark, sf):
    segment = F.col("segment")
    return processes(spark, sf, "proc_key", "segment", "duration_unit").select(
        "proc_key",
        X.canonicalize_text(segment).alias("plain"),
        X.canonicalize_text(segment, preserve_not_applicable=True).alias("kept"),
        X.canonicalize_text(segment, missing_label="SIN_DATO").alias("labelled"),
        X.canonicalize_text(F.col("duration_unit"), preserve_unknown=True).alias("unit"),
    )


@query("missing_state", with_p(f"""
SELECT *, CASE WHEN segment_state = 'present' THEN 0 ELSE 1 END + CASE WHEN nation_state = 'present' THEN 0 ELSE 1 END
          AS absent_fields
FROM (SELECT proc_key,
  CASE WHEN t IS NULL OR t IN ('no definido', 'n/a', 'na', 'null', 'none', 'no especificado') THEN 'missing'
       WHEN t = 'no aplica' THEN 'not_applicable' WHEN t = 'no adjudicado' THEN 'not_yet_available'
       ELSE 'present' END AS segment_state,
  CASE WHEN nation IS NULL THEN 'missing' ELSE 'present' END AS nation_state
  FROM (SELECT proc_key, nation, {_SEG_TOKEN} AS t FROM P))"""))
def _(spark, sf):
    states = processes(spark, sf, "proc_key", "segment", "nation").select(
        "proc_key", X.missing_state(F.col("segment")).alias("segment_state"), X.missing_state(F.col("nation")).alias("nation_state")
    )
    absent = (F.col("segment_state") != "present").cast("int") + (F.col("nation_state") != "present").cast("int")
    return states.withColumn("absent_fields", absent)


@query("non_placeholder", with_p(f"""
SELECT proc_key, NOT {sql_placeholder('segment')} AS segment_ok, NOT {sql_placeholder('description')} AS description_ok,
  NOT {sql_placeholder('url')} AS url_ok FROM P"""))
def _(spark, sf):
    return processes(spark, sf, "proc_key", "segment", "description", "url").select(
        "proc_key", *[X.non_placeholder(F.col(c)).alias(f"{c}_ok") for c in ("segment", "description", "url")]
    )


@query("multivalue_text", with_p("""
SELECT proc_key, nullif(array_to_string(list_filter(pieces, lambda x, i: x <> '' AND list_position(pieces, x) = i), ', '), '') AS tags
FROM (SELECT proc_key, list_transform(string_split(
        CASE WHEN tags LIKE '[%]' THEN substr(tags, 2, length(tags) - 2) ELSE tags END, ','), lambda x: trim(x)) AS pieces FROM P)"""))
def _(spark, sf):
    return processes(spark, sf, "proc_key", "tags").select("proc_key", X.multivalue_text(F.col("tags")).alias("tags"))


@query("json_field", """
SELECT event_id, json_extract_string(props, '$.k') AS k, props AS whole FROM events""")
def _(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.col("props").alias("whole")
    )


@query("flatten_url_forms", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('https://example.org/e/', event_id) END AS from_struct,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('https://example.org/e/', event_id) END AS from_json, concat('https://example.org/e/', event_id) AS from_text FROM events""")
def _(spark, sf):
    url = F.concat(F.lit("https://example.org/e/"), F.col("event_id").cast("string"))
    made = F.when(F.col("event_id") % 3 != 0, url)
    rows = table(spark, sf, "events").select(
        "event_id", F.struct(made.alias("url")).alias("s"), F.to_json(F.struct(made.alias("url"))).alias("j"), F.concat(F.lit("  "), url).alias("t"),
    )
    return rows.select("event_id", *[X.flatten_url(rows, c).alias(n) for c, n in (("s", "from_struct"), ("j", "from_json"), ("t", "from_text"))])


@query("hashable_groups", """
SELECT m, n FROM (SELECT concat('{"a":"', event_type, '","b":"', CAST(event_id % 5 AS VARCHAR), '"}') AS m, count(*) AS n FROM events GROUP BY 1)""")
def _(spark, sf):
    a, b = (F.lit("a"), F.col("event_type")), (F.lit("b"), (F.col("event_id") % 5).cast("string"))
    either = F.when(F.col("event_id") % 2 == 0, F.create_map(*a, *b)).otherwise(F.create_map(*b, *a))  # the same map in two orders
    rows = table(spark, sf, "events").select(either.alias("m"))
    return rows.select(X.hashable(rows, "m").alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))


@query("map_key_groups", """
SELECT props, count(*) AS n FROM (
  SELECT concat('{', array_to_string(list_sort(list_append(
    list_transform(json_keys(props), lambda k: concat('"', k, '":"', json_extract_string(props, concat('$."', k, '"')), '"')),
    concat('"event":"', event_type, '"'))), ','), '}') AS props FROM events) GROUP BY props""")
def _(spark, sf):
    both = F.to_json(F.map_concat(
        F.from_json("props", "map<string,string>"), F.create_map(F.lit("event"), F.col("event_type"))
    ))
    return table(spark, sf, "events").select(X.sorted_json(both).alias("props")).groupBy("props").agg(F.count(F.lit(1)).alias("n"))


_DOC_NUMBER = r"""CASE WHEN regexp_matches(t, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(t AS DOUBLE) END"""


@query("to_numeric", f"""
SELECT event_id, plain, stripped FROM (
  SELECT event_id, {_DOC_NUMBER.replace('t,', 'a,').replace('(t AS', '(a AS')} AS plain,
    {_DOC_NUMBER.replace('t,', 'b,').replace('(t AS', '(b AS')} AS stripped
  FROM (SELECT event_id, trim(v) AS a, trim(translate(v, ',$%', '')) AS b
        FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 9 = 1 THEN '$1,200'
                               ELSE CAST(value AS VARCHAR) END AS v FROM events)))""", "plain stripped")
def _(spark, sf):
    value = F.col("value_text")
    return events(spark, sf).select(
        "event_id", N.to_number(value).alias("plain"), N.to_number(value, strip_symbols=True).alias("stripped")
    )


@query("to_datetime", f"""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE strftime(ts, '{STAMP}') END AS moment,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds FROM events""")
def _(spark, sf):
    parsed = events(spark, sf).select("event_id", N.to_timestamp(F.col("ts_text")).alias("moment"))
    return parsed.select("event_id", stamp("moment"), F.unix_seconds("moment").alias("seconds"))


@query("negatives_to_null", with_p("""
SELECT proc_key, CASE WHEN base_price >= 0 THEN base_price END AS base_price,
  CASE WHEN duration >= 0 THEN duration END AS duration, CASE WHEN n_lines >= 0 THEN n_lines END AS n_lines FROM P"""),
       "base_price duration")
def _(spark, sf):
    return processes(spark, sf, "proc_key", "base_price", "duration", "n_lines").select(
        "proc_key", *[N.non_negative(F.col(c)).alias(c) for c in ("base_price", "duration", "n_lines")]
    )


@query("log_features", with_p("""
SELECT proc_key, CASE WHEN base_price >= 0 THEN ln(1 + base_price) END AS price_log,
  least(1.0, greatest(0.0, ln(1 + coalesce(n_lines, 0)) / ln(11))) AS intensity FROM P"""), "price_log intensity")
def _(spark, sf):
    total = F.coalesce(F.col("n_lines"), F.lit(0))
    return processes(spark, sf, "proc_key", "base_price", "n_lines").select(
        "proc_key", N.log1p(F.col("base_price")).alias("price_log"),
        N.clip(F.log1p(total) / F.log1p(F.lit(10.0))).alias("intensity"),
    )


@query("day_deltas", with_p(f"""
SELECT proc_key, {sql_days('published', 'received')} AS whole_received, {sql_micros_days('published', 'received')} AS exact_received,
  {sql_days('published', 'shifted')} AS whole_shifted, {sql_micros_days('published', 'shifted')} AS exact_shifted
FROM (SELECT *, published - INTERVAL 1 HOUR AS shifted FROM P)"""), "exact_received exact_shifted")
def _(spark, sf):
    rows = processes(spark, sf, "proc_key", "published", "received").withColumn(
        "shifted", F.col("published") - F.expr("INTERVAL 1 HOUR")
    )
    start = F.col("published")
    return rows.select(
        "proc_key",
        N.whole_days(start, F.col("received")).alias("whole_received"),
        N.fractional_days(start, F.col("received")).alias("exact_received"),
        N.whole_days(start, F.col("shifted")).alias("whole_shifted"),
        N.fractional_days(start, F.col("shifted")).alias("exact_shifted"),
    )


@query("guarded_ratio", with_p("""
SELECT proc_key, CASE WHEN n_returned > 0 THEN CAST(n_suppliers AS DOUBLE) / n_returned END AS ratio FROM P"""), "ratio")
def _(spark, sf):
    return processes(spark, sf, "proc_key", "n_suppliers", "n_returned").select(
        "proc_key", N.guarded_ratio(F.col("n_suppliers"), F.col("n_returned")).alias("ratio")
    )


@query("pattern_flags", r"""
SELECT page_id, regexp_matches(trim(coalesce(url, '')), '(?i)^https?://[a-z0-9.-]+/.+$') AS is_url,
  regexp_matches(trim(coalesce(url, '')), '(?i)^HTTPS://') AS is_secure,
  regexp_matches(trim(coalesce(url, '')), '(?i)[?&]page=[0-9]+') AS is_paged FROM pages""")
def _(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        X.matches(url, r"^https?://[a-z0-9.-]+/.+$").alias("is_url"),
        X.matches(url, r"^HTTPS://").alias("is_secure"),
        X.matches(url, r"[?&]page=[0-9]+").alias("is_paged"),
    )


# -- derivations ------------------------------------------------------------


@query("price_extreme_flag", with_p("""
SELECT proc_key, clean_segment AS segment, CASE WHEN base_price >= 0 THEN base_price END AS base_price,
  coalesce(base_price = 0, FALSE) AS price_is_zero,
  CASE WHEN base_price >= 0 THEN ln(1 + base_price) END AS price_log,
  coalesce(base_price >= 0 AND base_price > coalesce(g.threshold, a.threshold), FALSE) AS flag_extreme_price
FROM C LEFT JOIN g ON C.clean_segment = g.clean_segment2 LEFT JOIN a ON TRUE""",
    f"C AS (SELECT proc_key, base_price, {sql_canonical('segment')} AS clean_segment FROM P)",
    """g AS (SELECT clean_segment AS clean_segment2, quantile_cont(base_price, 0.995) AS threshold FROM C
             WHERE base_price >= 0 AND clean_segment IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)""",
    "a AS (SELECT quantile_cont(base_price, 0.995) AS threshold FROM C WHERE base_price >= 0)",
), "base_price price_log")
def _(spark, sf):
    rows = processes(spark, sf, "proc_key", "segment", "base_price").withColumn("segment", X.canonicalize_text(F.col("segment")))
    return derive.with_price_flags(rows, SPEC)


_UNIT_DAYS = """CASE duration_unit WHEN 'Dia(s)' THEN 1.0 WHEN 'Mes(es)' THEN 30.0 WHEN 'ano' THEN 365.0
  WHEN 'HORAS' THEN 1.0::DOUBLE / 24 WHEN 'Semana(s)' THEN 7.0 END"""
_UNIT_NAME = """CASE duration_unit WHEN 'Dia(s)' THEN 'día(s)' WHEN 'Mes(es)' THEN 'Mes(es)' WHEN 'ano' THEN 'Año(s)'
  WHEN 'HORAS' THEN 'Hora(s)' WHEN 'Semana(s)' THEN 'Semana(s)' ELSE 'UNIDAD_DESCONOCIDA' END"""


@query("duration_days", with_p("""
SELECT proc_key, d AS duration, unit AS duration_unit, duration_days,
  coalesce(duration_days > greatest((SELECT quantile_cont(duration_days, 0.999) FROM C), 3650), FALSE) AS duration_improbable,
  unit = 'UNIDAD_DESCONOCIDA' AS unit_unknown
FROM C""", f"""C AS (SELECT proc_key, CASE WHEN duration >= 0 THEN duration END AS d, {_UNIT_NAME} AS unit,
  CASE WHEN duration >= 0 THEN duration END * CAST({_UNIT_DAYS} AS DOUBLE) AS duration_days FROM P)"""), "duration duration_days")
def _(spark, sf):
    rows = processes(spark, sf, "proc_key", "duration", "duration_unit")
    return derive.with_duration(rows, SPEC).select(
        "proc_key", "duration", "duration_unit", "duration_days", "duration_improbable", "unit_unknown"
    )


@query("winsorize_group", with_p("""
SELECT proc_key, mode, least(base_price, q.cap) AS base_price, base_price > q.cap AS was_capped
FROM P JOIN (SELECT mode AS m, quantile_cont(base_price, 0.99) AS cap FROM P GROUP BY 1) q ON P.mode = q.m"""), "base_price")
def _(spark, sf):
    rows = processes(spark, sf, "proc_key", "mode", "base_price")
    return derive.winsorize(rows, "base_price", "mode", 0.99)


@query("presence_flags", with_p("""
SELECT proc_key, description IS NOT NULL AS has_description, url IS NOT NULL AS has_url, tags IS NOT NULL AS has_multi_value,
  received IS NOT NULL AS has_received, opened IS NOT NULL AS has_opened, effective IS NOT NULL AS has_effective,
  nation IS NULL AS place_missing,
  CAST(published IS NULL AS INT) + CAST(received IS NULL AS INT) + CAST(opened IS NULL AS INT) + CAST(effective IS NULL AS INT)
    AS missing_dates FROM P"""))
def _(spark, sf):
    rows = processes(spark, sf, "proc_key", "description", "url", "tags", "nation", "published", "received", "opened", "effective")
    return rows.select("proc_key", *[c.alias(n) for n, c in derive.presence_flags(SPEC).items()])


@query("temporal_derive", with_p(f"""
SELECT *, received_before_published OR opened_before_received OR opened_before_published OR effective_before_received
  AS temporal_anomaly
FROM (SELECT proc_key,
  CASE WHEN {sql_days('published', 'received')} >= 0 THEN {sql_days('published', 'received')} END AS days_to_receipt,
  {sql_days('published', 'opened')} AS days_to_opening,
  {sql_days('published', 'coalesce(effective, opened, received)')} AS process_days,
  coalesce({sql_days('published', 'received')} < 0, FALSE) AS received_before_published,
  coalesce({sql_days('received', 'opened')} < 0, FALSE) AS opened_before_received,
  coalesce({sql_days('published', 'opened')} < 0, FALSE) AS opened_before_published,
  coalesce({sql_days('received', 'effective')} < 0, FALSE) AS effective_before_received FROM P)"""))
def _(spark, sf):
    rows = processes(spark, sf, "proc_key", "published", "received", "opened", "effective")
    metrics = derive.day_metrics(SPEC)
    return rows.select(
        "proc_key", *[c.alias(n) for n, c in derive.temporal_rules(SPEC).items()],
        metrics["days_to_opening"].alias("days_to_opening"), metrics["process_days"].alias("process_days"),
    )


@query("temporal_anomalies", with_p(f"""
SELECT proc_id, ref_id, state, strftime(published, '{STAMP}') AS published, strftime(received, '{STAMP}') AS received,
  strftime(opened, '{STAMP}') AS opened, strftime(effective, '{STAMP}') AS effective,
  coalesce(received < published, FALSE) AS flag_received_before_published,
  coalesce(opened < received, FALSE) AS flag_opened_before_received,
  coalesce(effective < received, FALSE) AS flag_effective_before_received,
  coalesce(opened < published, FALSE) AS flag_published_after_opened,
  coalesce(effective < published, FALSE) AS flag_published_after_effective
FROM P WHERE received < published OR opened < received OR effective < received OR opened < published OR effective < published"""))
def _(spark, sf):
    rows = processes(spark, sf, "proc_id", "ref_id", "state", "published", "received", "opened", "effective")
    found = derive.anomalous_rows(rows, SPEC)
    dates = ("published", "received", "opened", "effective")
    return found.select(*[stamp(c) if c in dates else c for c in found.columns])


@query("competition_features", with_p("""
SELECT proc_key, total > 0 AS competition_reported, ln(1 + total) AS competition_log,
  CASE WHEN n_lines > 0 THEN CAST(n_suppliers AS DOUBLE) / n_lines END AS supplier_ratio
FROM (SELECT *, coalesce(n_lines, 0) + coalesce(n_returned, 0) + coalesce(n_discounted, 0) + coalesce(n_suppliers, 0) AS total FROM P)"""),
       "competition_log supplier_ratio")
def _(spark, sf):
    rows = processes(spark, sf, "proc_key", "n_lines", "n_suppliers", "n_returned", "n_discounted")
    return rows.select("proc_key", *[c.alias(n) for n, c in derive.competition_features(SPEC).items()])


def _present_sql(columns) -> str:
    return " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in columns)


@query("row_completeness", with_p(f"""
SELECT proc_key, round(({_present_sql(SPEC.critical)}) / CAST({len(SPEC.critical)} AS DOUBLE), 4) AS critical_completeness,
  round(({_present_sql(P_COLUMNS)}) / CAST({len(P_COLUMNS)} AS DOUBLE), 4) AS record_completeness FROM P"""),
       "critical_completeness record_completeness")
def _(spark, sf):
    rows = processes(spark, sf)
    return rows.select(
        "proc_key", derive.completeness(list(SPEC.critical)).alias("critical_completeness"),
        derive.completeness(rows.columns).alias("record_completeness"),
    )


_ANOMALY_SQL = """coalesce(received < published, FALSE) OR coalesce(opened < received, FALSE) OR coalesce(effective < received, FALSE)
  OR coalesce(opened < published, FALSE) OR coalesce(effective < published, FALSE)"""

INDICATORS_CTE = f"""
IND AS (
  SELECT proc_id, ref_id, nation, state, segment,
    round(({_present_sql(P_COLUMNS)} + 1) / CAST({len(P_COLUMNS) + 1} AS DOUBLE), 4) AS record_completeness,
    url IS NOT NULL AS ind_url, description IS NOT NULL AS ind_description, coalesce(base_price > 0, FALSE) AS ind_price,
    proc_id IS NOT NULL AND ref_id IS NOT NULL AND category_code IS NOT NULL AS ind_keys,
    state IS NOT NULL AND state <> 'No Definido' AND segment IS NOT NULL AND segment <> 'No Definido' AS ind_states,
    coalesce(n_lines, 0) + coalesce(n_returned, 0) + coalesce(n_discounted, 0) + coalesce(n_suppliers, 0) > 0 AS ind_competition,
    published IS NOT NULL AND received IS NOT NULL AND opened IS NOT NULL AND NOT temporal_anomaly AS ind_temporal,
    temporal_anomaly
  FROM (SELECT *, {_ANOMALY_SQL} AS temporal_anomaly FROM P))"""


def indicators(spark, sf):
    rows = processes(spark, sf).withColumn("temporal_anomaly", derive.timestamp_rules(SPEC)["temporal_anomaly"])
    return derive.row_indicators(rows, SPEC, ("proc_id", "ref_id", "category_code"), ("state", "segment"))


@query("row_indicators", with_p("SELECT * FROM IND", INDICATORS_CTE), "record_completeness")
def _(spark, sf):
    return indicators(spark, sf).select(
        "proc_id", "ref_id", "nation", "state", "segment", "record_completeness", "ind_url", "ind_description", "ind_price",
        "ind_keys", "ind_states", "ind_competition", "ind_temporal", "temporal_anomaly",
    )


# -- scores -----------------------------------------------------------------


def _sum_sql(weights: dict[str, float]) -> str:
    total = " + ".join(["CAST(0 AS DOUBLE)", *[f"CAST({c} AS DOUBLE) * CAST({w} AS DOUBLE)" for c, w in weights.items()]])
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {total}))"


def _flag_sql(condition: str) -> str:
    return f"CAST(coalesce({condition}, FALSE) AS INT)"


def _ok(x: str) -> str:
    return f"NOT {sql_placeholder(x)}"


_RESPONSES = "(coalesce(n_lines, 0) + coalesce(n_returned, 0) + coalesce(n_discounted, 0))"

SCORE_CTES = (
    f"""
E1 AS (
  SELECT *, CAST(length(trim(coalesce(description, ''))) AS INT) AS description_length,
    {sql_micros_days('published', 'received')} AS days_published_received,
    {sql_micros_days('received', 'opened')} AS days_received_opened,
    {sql_micros_days('published', 'opened')} AS days_published_opened,
    CAST({_RESPONSES} AS DOUBLE) AS total_responses, CAST(coalesce(n_suppliers, 0) AS DOUBLE) AS total_interest
  FROM P)""",
    f"""
E2 AS (
  SELECT *,
    {_flag_sql(_ok('description') + ' AND description_length >= 20')} AS flag_useful_description,
    {_flag_sql(_ok('category_code'))} AS flag_has_category,
    {_flag_sql('base_price > 0')} AS flag_has_price,
    {_flag_sql(_ok('nation'))} AS flag_has_place,
    {_flag_sql(_ok('mode') + ' AND ' + _ok('segment'))} AS flag_has_type_and_mode,
    {_flag_sql("regexp_matches(trim(coalesce(proc_id, '')), '(?i)" + SPEC.id_pattern + "')")} AS flag_valid_id,
    {_flag_sql(_ok('ref_id') + ' AND length(trim(ref_id)) >= 5')} AS flag_valid_reference,
    {_flag_sql("regexp_matches(trim(coalesce(url, '')), '(?i)" + SPEC.url_pattern + "')")} AS flag_public_url,
    {_flag_sql(_ok('tags'))} AS flag_has_portfolio,
    0 AS duplicate_penalty,
    {_flag_sql('published IS NOT NULL AND received IS NOT NULL AND opened IS NOT NULL')} AS flag_dates_available,
    {_flag_sql('days_published_received >= 0')} AS flag_published_before_received,
    {_flag_sql('days_received_opened >= 0')} AS flag_received_before_opened,
    {_flag_sql('days_published_received BETWEEN 0 AND 90')} AS flag_receipt_window_ok,
    {_flag_sql('days_received_opened BETWEEN 0 AND 30')} AS flag_opening_window_ok,
    {_flag_sql('total_responses > 0 OR total_interest > 0')} AS flag_participation,
    {_flag_sql('n_suppliers >= 2 OR n_lines >= 2')} AS flag_minimal_competition,
    {_flag_sql('n_lines IS NOT NULL OR n_returned IS NOT NULL OR n_discounted IS NOT NULL OR n_suppliers IS NOT NULL')} AS flag_competition_data,
    greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), ln(1 + total_responses + coalesce(n_suppliers, 0)) / ln(CAST(11 AS DOUBLE)))) AS competition_intensity
  FROM E1)""",
    f"""
E3 AS (
  SELECT *,
    5 - (flag_useful_description + flag_has_category + flag_has_price + flag_has_place + flag_has_type_and_mode) AS missing_required_fields,
    CASE WHEN flag_dates_available = 1 AND flag_published_before_received = 1 AND flag_received_before_opened = 1
          AND flag_receipt_window_ok = 1 AND flag_opening_window_ok = 1 THEN 1 ELSE 0 END AS flag_temporal_coherence,
    {_sum_sql(COMPLETENESS_WEIGHTS)} AS score_completeness,
    {_sum_sql(TRACEABILITY_WEIGHTS)} AS score_traceability_base,
    {_sum_sql(TEMPORAL_WEIGHTS)} AS score_temporal,
    {_sum_sql(COMPETITION_WEIGHTS)} AS score_competition
  FROM E2)""",
    """
E4 AS (SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE),
         score_traceability_base - duplicate_penalty * CAST(0.35 AS DOUBLE))) AS score_traceability FROM E3)""",
    f"""
E5 AS (SELECT *, {_sum_sql(TOTAL_WEIGHTS)} AS quality_score FROM E4)""",
    f"""
E6 AS (
  SELECT *,
    CASE WHEN quality_score < CAST(0.65 AS DOUBLE) THEN 1 ELSE 0 END AS low_quality_risk,
    CASE WHEN quality_score < CAST(0.5 AS DOUBLE) THEN 'alto' WHEN quality_score < CAST(0.65 AS DOUBLE) THEN 'medio' ELSE 'bajo' END AS risk_level,
    1 AS evidence_completeness,
    CASE WHEN {' + '.join(_flag_sql(_ok(c)) for c in ('proc_id', 'ref_id', 'url', 'tags'))} >= 3 THEN 1 ELSE 0 END AS evidence_traceability,
    CASE WHEN {_flag_sql('published IS NOT NULL AND received IS NOT NULL AND opened IS NOT NULL')}
       + 2 * {_flag_sql('published IS NOT NULL AND received IS NOT NULL')}
       + 2 * {_flag_sql('received IS NOT NULL AND opened IS NOT NULL')} >= 3 THEN 1 ELSE 0 END AS evidence_temporal,
    flag_competition_data AS evidence_competition
  FROM E5)""",
    """
E7 AS (SELECT *, (evidence_completeness + evidence_traceability + evidence_temporal + evidence_competition) / CAST(4 AS DOUBLE) AS evidence_coverage,
         abs(quality_score - CAST(0.65 AS DOUBLE)) AS margin_to_threshold FROM E6)""",
    """
E8 AS (SELECT *, CASE WHEN evidence_coverage >= 0.75 AND margin_to_threshold >= CAST(0.15 AS DOUBLE) THEN 'alta'
         WHEN evidence_coverage >= 0.5 AND margin_to_threshold >= CAST(0.07 AS DOUBLE) THEN 'media' ELSE 'baja' END AS label_confidence FROM E7)""",
)


def with_scores(body: str, *ctes: str) -> str:
    return with_p(body, *SCORE_CTES, *ctes)


def scored(spark, sf):
    return score(processes(spark, sf), SPEC)


FLAGS = (
    *COMPLETENESS_WEIGHTS, *TRACEABILITY_WEIGHTS, *TEMPORAL_WEIGHTS, *[c for c in COMPETITION_WEIGHTS if c.startswith("flag")],
    "flag_temporal_coherence",
)
MEASURES = ("description_length", "missing_required_fields", "duplicate_penalty", "total_responses", "total_interest",
            "days_published_received", "days_received_opened", "days_published_opened", "competition_intensity")
SCORES = ("score_completeness", "score_traceability_base", "score_traceability", "score_temporal", "score_competition", "quality_score")


@query("engineered_flags", with_scores(f"SELECT proc_key, {', '.join((*FLAGS, *MEASURES))} FROM E3"),
       "total_responses total_interest days_published_received days_received_opened days_published_opened competition_intensity")
def _(spark, sf):
    return engineer_flags(processes(spark, sf), SPEC).select("proc_key", *FLAGS, *MEASURES)


@query("quality_scores", with_scores(f"SELECT proc_key, {', '.join(SCORES)} FROM E5"), " ".join(SCORES))
def _(spark, sf):
    return add_scores(engineer_flags(processes(spark, sf), SPEC)).select("proc_key", *SCORES)


@query("risk_labels", with_scores("SELECT proc_key, quality_score, low_quality_risk, risk_level FROM E6"), "quality_score")
def _(spark, sf):
    return scored(spark, sf).select("proc_key", "quality_score", "low_quality_risk", "risk_level")


CONFIDENCE = ("evidence_completeness", "evidence_traceability", "evidence_temporal", "evidence_competition",
              "evidence_coverage", "margin_to_threshold", "label_confidence")


@query("label_confidence", with_scores(f"SELECT proc_key, {', '.join(CONFIDENCE)} FROM E8"), "evidence_coverage margin_to_threshold")
def _(spark, sf):
    rows = add_labels(add_scores(engineer_flags(processes(spark, sf), SPEC)), SPEC)
    return rows.select("proc_key", *CONFIDENCE)


@query("score_pipeline", with_scores(f"""
SELECT proc_id, {', '.join(FLAGS)}, {', '.join(SCORES)}, low_quality_risk, risk_level, evidence_coverage, margin_to_threshold, label_confidence
FROM E8"""), " ".join((*SCORES, "evidence_coverage", "margin_to_threshold")))
def _(spark, sf):
    return scored(spark, sf).select(
        "proc_id", *FLAGS, *SCORES, "low_quality_risk", "risk_level", "evidence_coverage", "margin_to_threshold", "label_confidence"
    )


# -- deduplication ----------------------------------------------------------

_DATES = ("published", "received", "opened", "effective")


def _stamped_sql(source: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'''strftime({c}, '{STAMP}') AS {c}''' for c in _DATES)}) FROM {source}"


def _stamped(df):
    return df.select(*[stamp(c) if c in _DATES else c for c in df.columns])


@query("dedup_exact", with_pd(_stamped_sql(f"(SELECT {', '.join(P_COLUMNS)}, count(*) > 1 AS was_exact_duplicate FROM PD GROUP BY ALL)")), "base_price duration")
def _(spark, sf):
    return _stamped(dedup.drop_exact(duplicated(spark, sf)))


@query("dedup_logical", with_pd(_stamped_sql(f"""(
  SELECT * EXCLUDE (r, s) FROM (
    SELECT *, count(*) OVER (PARTITION BY proc_id) > 1 AS was_logical_duplicate,
      row_number() OVER (PARTITION BY proc_id ORDER BY s DESC, published DESC NULLS LAST, proc_key DESC) AS r
    FROM (SELECT *, {_present_sql(P_COLUMNS)} AS s FROM (SELECT DISTINCT * FROM PD))) WHERE r = 1)""")), "base_price duration")
def _(spark, sf):
    distinct = dedup.drop_exact(duplicated(spark, sf)).drop("was_exact_duplicate")
    return _stamped(dedup.drop_logical(distinct, "proc_id", distinct.columns, "published", ("proc_key",)))


@query("dup_group_variation", with_pd(f"""
SELECT 'base_price' AS "column", count(*) AS groups, CAST(sum(CASE WHEN v > 1 THEN 1 ELSE 0 END) AS BIGINT) AS varying_groups,
  round(sum(CASE WHEN v > 1 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 4) AS variation_pct
FROM (SELECT ref_id, count(*) AS c, count(DISTINCT base_price) AS v FROM PD GROUP BY 1 HAVING count(*) > 1)
UNION ALL
SELECT 'mode', count(*), CAST(sum(CASE WHEN v > 1 THEN 1 ELSE 0 END) AS BIGINT),
  round(sum(CASE WHEN v > 1 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 4)
FROM (SELECT ref_id, count(*) AS c, count(DISTINCT mode) AS v FROM PD GROUP BY 1 HAVING count(*) > 1)
UNION ALL
SELECT 'nation', count(*), CAST(sum(CASE WHEN v > 1 THEN 1 ELSE 0 END) AS BIGINT),
  round(sum(CASE WHEN v > 1 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 4)
FROM (SELECT ref_id, count(*) AS c, count(DISTINCT nation) AS v FROM PD GROUP BY 1 HAVING count(*) > 1)"""), "variation_pct")
def _(spark, sf):
    return dedup.variation_in_groups(
        duplicated(spark, sf, "ref_id", "base_price", "mode", "nation"), "ref_id", ["base_price", "mode", "nation"]
    )


_CLEAN_OUT = (
    "proc_id", "ref_id", "url", "description", "category_code", "mode", "base_price", "segment", "nation", "tags", "duration",
    "duration_unit", "n_lines", "n_suppliers", "was_exact_duplicate", "was_logical_duplicate", "price_is_zero", "price_log",
    "flag_extreme_price", "duration_days", "duration_improbable", "unit_unknown", "has_description", "has_url", "has_multi_value",
    "place_missing", "has_received", "has_opened", "has_effective", "missing_dates", "days_to_receipt", "effective_before_received",
    "temporal_anomaly", "competition_reported", "competition_log", "supplier_ratio", "critical_completeness",
)

CLEAN_CTES = (
    f"""
B AS (SELECT * REPLACE (CASE WHEN base_price >= 0 THEN base_price END AS base_price, CASE WHEN duration >= 0 THEN duration END AS duration,
        {sql_canonical('description')} AS description, {sql_canonical('segment')} AS segment,
        nullif(array_to_string(list_filter(list_transform(string_split(CASE WHEN tags LIKE '[%]' THEN substr(tags, 2, length(tags) - 2)
          ELSE tags END, ','), lambda x: trim(x)), lambda x, i: x <> '' AND list_position(list_transform(string_split(
          CASE WHEN tags LIKE '[%]' THEN substr(tags, 2, length(tags) - 2) ELSE tags END, ','), lambda x2: trim(x2)), x) = i), ', '), '') AS tags)
      FROM PD)""",
    """
TG AS (SELECT segment AS tg_segment, quantile_cont(base_price, 0.995) AS threshold FROM B
       WHERE base_price >= 0 AND segment IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)""",
    "TA AS (SELECT quantile_cont(base_price, 0.995) AS threshold FROM B WHERE base_price >= 0)",
    f"""
TD AS (SELECT greatest(3650, quantile_cont(CASE WHEN duration >= 0 THEN duration END * CAST({_UNIT_DAYS} AS DOUBLE), 0.999)) AS days FROM B)""",
    f"""
DX AS (SELECT {', '.join(P_COLUMNS)}, count(*) > 1 AS was_exact_duplicate FROM B GROUP BY ALL)""",
    f"""
DV AS (
  SELECT DX.* REPLACE (CASE WHEN base_price >= 0 THEN base_price END AS base_price, CASE WHEN duration >= 0 THEN duration END AS duration,
           {_UNIT_NAME} AS duration_unit),
    coalesce(base_price = 0, FALSE) AS price_is_zero, CASE WHEN base_price >= 0 THEN ln(1 + base_price) END AS price_log,
    coalesce(base_price >= 0 AND base_price > coalesce(TG.threshold, TA.threshold), FALSE) AS flag_extreme_price,
    CASE WHEN duration >= 0 THEN duration END * CAST({_UNIT_DAYS} AS DOUBLE) AS duration_days,
    coalesce(CASE WHEN duration >= 0 THEN duration END * CAST({_UNIT_DAYS} AS DOUBLE) > TD.days, FALSE) AS duration_improbable,
    {_UNIT_NAME} = 'UNIDAD_DESCONOCIDA' AS unit_unknown,
    description IS NOT NULL AS has_description, url IS NOT NULL AS has_url, tags IS NOT NULL AS has_multi_value,
    nation IS NULL AS place_missing, received IS NOT NULL AS has_received, opened IS NOT NULL AS has_opened,
    effective IS NOT NULL AS has_effective,
    CAST(published IS NULL AS INT) + CAST(received IS NULL AS INT) + CAST(opened IS NULL AS INT) + CAST(effective IS NULL AS INT) AS missing_dates,
    CASE WHEN {sql_days('published', 'received')} >= 0 THEN {sql_days('published', 'received')} END AS days_to_receipt,
    coalesce({sql_days('received', 'effective')} < 0, FALSE) AS effective_before_received,
    coalesce({sql_days('published', 'received')} < 0, FALSE) OR coalesce({sql_days('received', 'opened')} < 0, FALSE)
      OR coalesce({sql_days('published', 'opened')} < 0, FALSE) OR coalesce({sql_days('received', 'effective')} < 0, FALSE) AS temporal_anomaly,
    coalesce(n_lines, 0) + coalesce(n_returned, 0) + coalesce(n_discounted, 0) + coalesce(n_suppliers, 0) > 0 AS competition_reported,
    ln(1 + coalesce(n_lines, 0) + coalesce(n_returned, 0) + coalesce(n_discounted, 0) + coalesce(n_suppliers, 0)) AS competition_log,
    CASE WHEN n_lines > 0 THEN CAST(n_suppliers AS DOUBLE) / n_lines END AS supplier_ratio,
    round((CAST(ref_id IS NOT NULL AS INT) + CAST(published IS NOT NULL AS INT) + CAST(description IS NOT NULL AS INT)
      + CAST(coalesce(base_price, -1) >= 0 AS INT) + CAST(mode IS NOT NULL AS INT) + CAST(segment IS NOT NULL AS INT)
      + CAST(url IS NOT NULL AS INT) + CAST(nation IS NOT NULL AS INT)) / CAST(8 AS DOUBLE), 4) AS critical_completeness
  FROM DX LEFT JOIN TG ON DX.segment = TG.tg_segment LEFT JOIN TA ON TRUE LEFT JOIN TD ON TRUE)""",
    """
CL AS (
  SELECT * FROM (
    SELECT *, count(*) OVER (PARTITION BY proc_id) > 1 AS was_logical_duplicate,
      row_number() OVER (PARTITION BY proc_id ORDER BY base_price IS NOT NULL DESC, proc_key DESC) AS r
    FROM DV) WHERE r = 1)""",
)


@query("clean_pipeline", with_pd(f"SELECT {', '.join(_CLEAN_OUT)} FROM CL", *CLEAN_CTES),
       "base_price duration price_log duration_days competition_log supplier_ratio critical_completeness")
def _(spark, sf):
    return clean(duplicated(spark, sf), SPEC, nfkc=False).select(*_CLEAN_OUT)


def _cleaning_audit_sql() -> str:
    """The raw cells of each process by what cleaning makes of them; copies of a process change in the same way."""
    canonical = {c: sql_canonical(c) for c in ("description", "segment", "nation", "mode", "category_code")} | {"state": sql_text("state")}
    canonical["tags"] = "CASE WHEN tags = '[A, B, A]' THEN 'A, B' ELSE tags END"
    parts = []
    for c in P_COLUMNS:
        form = canonical.get(c, c)
        role = column_role(c, SPEC)
        counts = {
            "unreadable": "FALSE", "placeholder": f"{c} IS NOT NULL AND {form} IS NULL", "rewritten": f"{form} <> {c}",
            "negative": f"{c} < 0" if c in ("base_price", "duration") else "FALSE",
            "unit": f"{c} IS DISTINCT FROM {_UNIT_NAME}" if c == "duration_unit" else "FALSE",
        }
        cells = ", ".join(f"count(*) FILTER ({condition}) AS {kind}" for kind, condition in counts.items())
        fixed = f"'{role}'" if role else "CAST(NULL AS VARCHAR)"
        parts.append(f"""SELECT '{c}' AS "column", {fixed} AS fixed_role, {cells} FROM P""")
    rules = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ROLE_RULES.items())
    union_all = "\nUNION ALL\n".join(parts)
    return with_pd(f"""
SELECT "column", role, CASE role {rules} END AS rule, unreadable, placeholder, rewritten, negative, unit, cells_changed,
  (SELECT count(*) FROM PD) - (SELECT count(*) FROM DX) AS exact_copies_dropped, (SELECT count(*) FROM DX) - (SELECT count(*) FROM CL) AS logical_copies_dropped
FROM (SELECT *, coalesce(fixed_role, CASE WHEN cells_changed > 0 THEN 'transformed' ELSE 'keep' END) AS role
  FROM (SELECT *, unreadable + placeholder + rewritten + negative + unit AS cells_changed FROM (
{union_all})))""", *CLEAN_CTES)


@query("cleaning_audit", _cleaning_audit_sql())
def _(spark, sf):
    return cleaning_audit(clean(duplicated(spark, sf), SPEC, nfkc=False, track=True), P_COLUMNS, SPEC)

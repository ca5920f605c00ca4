"""Column decisions (P), lookups and set operations (J), windows and samples (W), dependency checks (X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import numbers as N
from assayer.operators import columns as C
from assayer.operators import lookups as L
from assayer.workload.fixtures import P_COLUMNS, SPEC, events, processes, table, with_p
from assayer.workload.q_profiles import sql_pct, union
from assayer.workload.q_rows import WS, sql_canonical, sql_text, stamp
from assayer.workload.registry import query


@query("normalize_columns", """
SELECT n_nationkey AS codigo_de_nacion, n_name AS nombre, n_regionkey AS region_id FROM nation""")
def _(spark, sf):
    raw = table(spark, sf, "nation").toDF("Código de  Nación", " NOMBRE ", "__Región-ID__")
    return C.normalize_columns(raw)


@query("drop_columns", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def _(spark, sf):
    return C.drop_required(table(spark, sf, "orders"), ["o_orderstatus", "o_totalprice", "o_orderdate"])


_CONTRACT = SPEC.required()


@query("contract_check", with_p("\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{C.expected_kind(c, SPEC)}' AS expected_type, count(*) - count({c}) AS null_count FROM P""" for c in _CONTRACT)))
def _(spark, sf):
    return C.contract_check(processes(spark, sf), SPEC)


@query("role_drop", with_p(f"""
SELECT * REPLACE (strftime(published, '%Y-%m-%d %H:%M:%S') AS published, strftime(received, '%Y-%m-%d %H:%M:%S') AS received,
  strftime(opened, '%Y-%m-%d %H:%M:%S') AS opened) FROM (SELECT {', '.join(c for c in P_COLUMNS if c not in SPEC.dropped)} FROM P)"""),
       "base_price duration")
def _(spark, sf):
    kept = C.role_drop(processes(spark, sf), SPEC)
    return kept.select(*[stamp(c) if c in ("published", "received", "opened") else c for c in kept.columns])


def _audit_sql() -> str:
    forms = {
        "description": sql_canonical("description"), "segment": sql_canonical("segment"), "state": sql_text("state"), "mode": sql_text("mode"),
        "duration_unit": sql_text("duration_unit"), "nation": sql_text("nation"),
        "tags": "CASE WHEN tags = '[A, B, A]' THEN 'A, B' ELSE tags END",
    }
    rows = []
    for c in P_COLUMNS:
        role = C.column_role(c, SPEC)
        cells = f"count(*) FILTER ({c} IS DISTINCT FROM {forms[c]})" if c in forms else "count(*) FILTER (FALSE)"
        fixed = f"'{role}'" if role else "CAST(NULL AS VARCHAR)"
        rows.append(f"""SELECT '{c}' AS "column", {fixed} AS fixed_role, {cells} AS cells_changed FROM P""")
    rules = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ROLE_RULES.items())
    return with_p(f"""
SELECT "column", role, CASE role {rules} END AS rule, cells_changed FROM (
  SELECT *, coalesce(fixed_role, CASE WHEN cells_changed > 0 THEN 'transformed' ELSE 'keep' END) AS role FROM (
{' UNION ALL '.join(rows)}))""")


@query("column_audit", _audit_sql())
def _(spark, sf):
    return C.column_audit(processes(spark, sf), SPEC, nfkc=False)


_SQL_TYPES = "CASE typeof(any_value({c})) WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'timestamp' END"


def group_sql(column: str, position: int, source: str) -> str:
    """Position, type and semantic group of one column: its type first, its role second, 0/1 values last."""
    named = "'text'" if column == SPEC.description else "'technical'" if column in SPEC.traceability else "'categorical'"
    return f"""SELECT {position} AS column_position, '{column}' AS "column", dtype, CASE WHEN dtype = 'timestamp' THEN 'datetime' WHEN dtype = 'boolean' THEN 'boolean'
  WHEN dtype = 'string' THEN {named} WHEN inside THEN 'binary_numeric' ELSE 'numeric' END AS semantic_group
FROM (SELECT {_SQL_TYPES.format(c=column)} AS dtype, bool_and(CAST({column} AS VARCHAR) IN ('0', '1', '0.0', '1.0')) AS inside FROM {source})"""


@query("column_groups", with_p("\nUNION ALL\n".join(
    group_sql(c, i, "(SELECT *, url IS NOT NULL AS has_url, CAST(base_price > 0 AS INT) AS flag_price FROM P)") for i, c in enumerate((*P_COLUMNS, "has_url", "flag_price"), 1))))
def _(spark, sf):
    rows = processes(spark, sf).withColumns({"has_url": F.col("url").isNotNull(), "flag_price": (F.col("base_price") > 0).cast("int")})
    return C.group_table(rows, SPEC)


_BIN = ("is_big", "zero", "n_lines", "duration")


@query("binary_like", with_p(union("""SELECT '{c}' AS "column", count({c}) AS non_null_count, bool_and({c} IN (0, 1)) AND count({c}) > 0 AS is_binary_like
FROM (SELECT *, CAST(base_price > 100000 AS INT) AS is_big, 0 AS zero FROM P)""", _BIN)))
def _(spark, sf):
    rows = processes(spark, sf, "base_price", "n_lines", "duration").withColumns(
        {"is_big": (F.col("base_price") > 100000).cast("int"), "zero": F.lit(0)}
    )
    return C.binary_like(rows, _BIN)


@query("date_candidates", f"""
SELECT "column", non_null_count, parsed, {sql_pct('parsed', 'non_null_count')} AS parsed_pct, parsed >= 0.5 * non_null_count AS is_candidate FROM (
{union('''SELECT '{c}' AS "column", count({c}) AS non_null_count, count(TRY_CAST({c} AS TIMESTAMP)) AS parsed FROM (
  SELECT event_type, props, CASE WHEN event_id % 9 = 0 THEN 'n/a' WHEN event_id % 9 = 1 THEN '$1,200' ELSE CAST(value AS VARCHAR) END AS value_text,
    CASE WHEN event_id % 10 = 0 THEN 'sin fecha' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text FROM events)''', ('event_type', 'props', 'value_text', 'ts_text'))})""",
       "parsed_pct")
def _(spark, sf):
    return C.date_candidates(events(spark, sf), ["event_type", "props", "value_text", "ts_text"])


_REC = ("proc_id", "ref_id", "url", "description", "state", "mode", "segment", "nation", "tags", "duration_unit", "n_lines")


@query("column_recommendations", with_p(f"""
SELECT "column", null_pct, dominant_share_pct, CAST(len(labels) AS INT) AS recommendation_count,
  CASE WHEN len(labels) > 0 THEN array_to_string(labels, ' | ') ELSE 'ok' END AS recommendations
FROM (SELECT coalesce(a."column", l.c) AS "column", coalesce(null_pct, 0) AS null_pct, dominant_share_pct, list_filter([
    CASE WHEN coalesce(null_pct, 0) > 30 THEN 'high_nulls' END, CASE WHEN dominant_share_pct >= 95 THEN 'near_constant' END,
    CASE WHEN l.c IS NOT NULL THEN 'potential_leakage' END, CASE WHEN a."column" = 'proc_id' THEN 'primary_identifier' END,
    CASE WHEN a."column" = 'ref_id' THEN 'non_unique_reference_identifier' END], lambda x: x IS NOT NULL) AS labels
  FROM ({union(f'''SELECT '{{c}}' AS "column", {sql_pct('coalesce(sum(n) FILTER (v IS NULL), 0)', 'sum(n)')} AS null_pct,
    {sql_pct('max(n)', 'sum(n)')} AS dominant_share_pct FROM (SELECT CAST({{c}} AS VARCHAR) AS v, count(*) AS n FROM P GROUP BY 1)''', _REC)}) a
  FULL JOIN (SELECT unnest(['state', 'effective']) AS c) l ON a."column" = l.c)"""), "null_pct dominant_share_pct")
def _(spark, sf):
    return C.recommendations(processes(spark, sf, *_REC), SPEC)


@query("conversion_summary", """
SELECT 'value_text' AS "column", 'numeric' AS conversion_type, count(*) AS non_null_before, count(*) FILTER (event_id % 9 <> 0) AS non_null_after,
  count(*) FILTER (event_id % 9 = 0) AS coerced_to_null, round(count(*) FILTER (event_id % 9 <> 0) * CAST(100 AS DOUBLE) / count(*), 2) AS parse_success_pct FROM events
UNION ALL
SELECT 'ts_text', 'datetime', count(*), count(*) FILTER (event_id % 10 <> 0), count(*) FILTER (event_id % 10 = 0),
  round(count(*) FILTER (event_id % 10 <> 0) * CAST(100 AS DOUBLE) / count(*), 2) FROM events""", "parse_success_pct")
def _(spark, sf):
    return C.conversion_summary(events(spark, sf), {
        "value_text": ("numeric", N.to_number(F.col("value_text"), strip_symbols=True)),
        "ts_text": ("datetime", N.to_timestamp(F.col("ts_text"))),
    })


@query("fd_check", """
SELECT 'c_custkey -> c_nationkey' AS dependency, count(*) AS groups, count(*) FILTER (v > 1) AS violating_groups, max(v) AS max_levels,
  count(*) FILTER (v > 1) = 0 AS holds, (SELECT avg(CAST(c_custkey = c_nationkey AS INT)) FROM customer) AS equal_rate
FROM (SELECT count(DISTINCT c_nationkey) AS v FROM customer GROUP BY c_custkey)
UNION ALL
SELECT 'c_mktsegment -> c_nationkey', count(*), count(*) FILTER (v > 1), max(v), count(*) FILTER (v > 1) = 0, 0
FROM (SELECT count(DISTINCT c_nationkey) AS v FROM customer GROUP BY c_mktsegment)""", "equal_rate")
def _(spark, sf):
    customer = table(spark, sf, "customer")
    return C.dependency_check(customer, "c_custkey", "c_nationkey").unionByName(C.dependency_check(customer, "c_mktsegment", "c_nationkey"))


# -- lookups and set operations --------------------------------------------


@query("top_n_categories", """
SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(spark, sf):
    return L.top_categories(table(spark, sf, "lineitem"), "l_suppkey", 15)


@query("top_n_semi", """
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)""")
def _(spark, sf):
    return L.keep_top(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_suppkey", 5)


@query("min_group_filter", with_p("""
SELECT proc_key, ref_id FROM P WHERE ref_id IN (SELECT ref_id FROM P GROUP BY 1 HAVING count(*) >= 12)"""))
def _(spark, sf):
    return L.keep_large_groups(processes(spark, sf, "proc_key", "ref_id"), "ref_id", 12)


_PAIR_COLUMNS = ("base_price", "duration", "n_lines", "n_suppliers", "n_returned", "n_discounted")
_PAIRS_SQL = f"""
N AS (SELECT unnest([{', '.join(f"'{c}'" for c in _PAIR_COLUMNS)}]) AS c, unnest(range({len(_PAIR_COLUMNS)})) AS i),
PAIRS AS (SELECT a.c AS left_column, b.c AS right_column FROM N a JOIN N b ON a.i < b.i)"""
_STATS = ", ".join(
    f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS \"{a}|{b}\"" for i, a in enumerate(_PAIR_COLUMNS) for b in _PAIR_COLUMNS[i + 1:]
)


def _pair_counts(spark, sf, exclude=()):
    """Pairs with the number of rows in which both columns are known."""
    rows = processes(spark, sf, *_PAIR_COLUMNS)
    both = rows.agg(*[
        F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"{a}|{b}")
        for i, a in enumerate(_PAIR_COLUMNS) for b in _PAIR_COLUMNS[i + 1:]
    ])
    counts = both.unpivot([], both.columns, "pair", "n_complete")
    pairs = L.column_pairs(spark, _PAIR_COLUMNS, exclude).withColumn("pair", F.concat_ws("|", "left_column", "right_column"))
    return pairs.join(F.broadcast(counts), "pair").drop("pair")


_COUNTED = f"C AS (UNPIVOT (SELECT {_STATS} FROM P) ON * INTO NAME pair VALUE n_complete)"


@query("column_pairs", with_p("SELECT left_column, right_column, n_complete FROM PAIRS JOIN C ON pair = left_column || '|' || right_column", _PAIRS_SQL, _COUNTED))
def _(spark, sf):
    return _pair_counts(spark, sf)


@query("pair_exclusion", with_p("""
SELECT left_column, right_column, n_complete FROM PAIRS JOIN C ON pair = left_column || '|' || right_column
WHERE NOT (left_column = 'n_lines' AND right_column = 'n_suppliers') AND NOT (left_column = 'base_price' AND right_column = 'duration')""", _PAIRS_SQL, _COUNTED))
def _(spark, sf):
    return _pair_counts(spark, sf, [("n_suppliers", "n_lines"), ("base_price", "duration")])


@query("key_setops", """
SELECT k AS key, CASE WHEN l AND r THEN 'both' WHEN l THEN 'left_only' ELSE 'right_only' END AS membership
FROM (SELECT k, bool_or(l) AS l, bool_or(r) AS r FROM (
  SELECT o_orderkey AS k, TRUE AS l, FALSE AS r FROM orders UNION ALL SELECT l_orderkey, FALSE, TRUE FROM lineitem) GROUP BY k)""")
def _(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    right = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return L.key_membership(left, right, "key")


# -- windows, collapses, samples -------------------------------------------


@query("collapse_categories", with_p("""
SELECT proc_key, CASE WHEN nation IS NULL THEN NULL WHEN nation IN (SELECT nation FROM P WHERE nation IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8)
  THEN nation ELSE 'Other' END AS nation FROM P"""))
def _(spark, sf):
    return L.collapse(processes(spark, sf, "proc_key", "nation"), "nation", 8)


@query("first_per_group", with_p("""
SELECT segment, category, successes, row_number() OVER (ORDER BY segment) AS rank FROM (
  SELECT segment, mode AS category, count(*) AS successes, row_number() OVER (PARTITION BY segment ORDER BY count(*) DESC, mode) AS r
  FROM P WHERE segment IS NOT NULL GROUP BY 1, 2) WHERE r = 1"""))
def _(spark, sf):
    counts = processes(spark, sf, "segment", "mode").filter(F.col("segment").isNotNull()).groupBy(
        "segment", F.col("mode").alias("category")
    ).agg(F.count(F.lit(1)).alias("successes"))
    return L.first_per_group(counts, "segment", [F.desc("successes"), F.col("category")])


@query("avg_rank", with_p("""
SELECT value, count(*) AS n, any_value(r) + (count(*) - 1) / 2.0::DOUBLE AS avg_rank FROM (
  SELECT base_price AS value, rank() OVER (ORDER BY base_price) AS r FROM P WHERE base_price IS NOT NULL) GROUP BY value"""), "value avg_rank")
def _(spark, sf):
    return L.average_ranks(processes(spark, sf, "base_price"), "base_price")


_MARK = "CAST(concat('0x', substr(md5(concat_ws('|', CAST(proc_key AS VARCHAR), '42')), 1, 15)) AS BIGINT)"


@query("stratified_sample", with_p(f"""
SELECT proc_key, mode, base_price FROM (
  SELECT *, row_number() OVER (PARTITION BY mode ORDER BY {_MARK}, proc_key) AS r, count(*) OVER (PARTITION BY mode) AS n, count(*) OVER () AS total FROM P)
WHERE r <= CASE WHEN total <= 1000 THEN n ELSE greatest(1, CAST(round_even(CAST(1000 AS DOUBLE) * n / total, 0) AS BIGINT)) END"""), "base_price")
def _(spark, sf):
    rows = processes(spark, sf, "proc_key", "mode", "base_price")
    return L.sample_rows(rows, 1000, ["proc_key"], "mode")


@query("plain_sample", with_p(f"SELECT proc_key, base_price FROM (SELECT *, row_number() OVER (ORDER BY {_MARK}, proc_key) AS r FROM P) WHERE r <= 500"), "base_price")
def _(spark, sf):
    return L.sample_rows(processes(spark, sf, "proc_key", "base_price"), 500, ["proc_key"])

"""Scans, windows and extracts (S), findings and run summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from assayer.functions import numbers as N
from assayer.operators import columns as C
from assayer.plans import report
from assayer.sources import scan, sinks
from assayer.workload.fixtures import P_COLUMNS, SPEC, duplicated, events, processes, table, with_p
from assayer.workload.q_profiles import sql_pct, union
from assayer.workload.q_rows import stamp
from assayer.workload.registry import query

TODAY = dt.date(1999, 6, 30)


@query("window_filter", """
SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-06-30' AND TIMESTAMP '1999-06-30'""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    kept = scan.window_filter(rows, "o_orderdate", 2, TODAY)
    return kept.select("o_orderkey", "o_custkey", stamp("o_orderdate"))


@query("capped_extract", """
SELECT o_orderkey, o_custkey, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM (
  SELECT * FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-06-30' AND TIMESTAMP '1999-06-30' ORDER BY o_orderdate, o_orderkey LIMIT 2000)""",
       "o_totalprice")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    capped = scan.capped_extract(scan.window_filter(rows, "o_orderdate", 2, TODAY), ["o_orderdate", "o_orderkey"], 2000)
    return capped.select("o_orderkey", "o_custkey", "o_totalprice", stamp("o_orderdate"))


@query("validated_window", """
SELECT event_id, ts_text, value FROM (SELECT event_id, value, CASE WHEN event_id % 10 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS ts_text FROM events)
WHERE ts_text BETWEEN '2024-01-02 00:00:00' AND '2024-01-20 12:00:00'""", "value")
def _(spark, sf):
    kept = scan.validated_window(events(spark, sf), "ts_text", "2024-01-02 00:00:00", "2024-01-20 12:00:00", ["event_id"])
    return kept.select("event_id", stamp("ts_text"), "value")


@query("stringify", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority,
  CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders""")
def _(spark, sf):
    text = sinks.stringify(table(spark, sf, "orders").drop("o_totalprice"), keep=("o_orderdate",))
    return text.withColumn("seconds", F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).drop("o_orderdate")


@query("key_findings", with_p(f"""
SELECT 'nulls' AS section, CAST(rank AS INT) AS rank, "column" AS item, CAST(null_pct AS DOUBLE) AS measure FROM (
  SELECT *, row_number() OVER (ORDER BY null_pct DESC, null_count DESC, "column") AS rank FROM (
    {union(f'''SELECT '{{c}}' AS "column", count(*) - count({{c}}) AS null_count, {sql_pct('(count(*) - count({c}))', 'count(*)')} AS null_pct FROM P''', P_COLUMNS)}
  )) WHERE rank <= 10
UNION ALL
SELECT 'repeated_keys', CAST(row_number() OVER (ORDER BY c DESC, k) AS INT), k, CAST(c AS DOUBLE) FROM (
  SELECT 'ref_id' AS k, (SELECT sum(c) FROM (SELECT count(*) AS c FROM P GROUP BY ref_id HAVING count(*) > 1)) AS c
  UNION ALL SELECT 'proc_id', (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM P GROUP BY proc_id HAVING count(*) > 1)))
UNION ALL
SELECT 'top_categories:' || "column", CAST(r AS INT), v, CAST(n AS DOUBLE) FROM (
  {union('''SELECT * FROM (SELECT '{c}' AS "column", {c} AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}) AS r FROM P
    WHERE {c} IS NOT NULL GROUP BY 2) WHERE r <= 5''', ('mode', 'segment', 'nation'))})"""), "measure")
def _(spark, sf):
    return report.key_findings(processes(spark, sf), ["proc_id", "ref_id"], ["mode", "segment", "nation"])


@query("run_summary", with_p("""
SELECT count(*) AS n_rows, 22 AS n_columns, (SELECT count(DISTINCT proc_id) FROM P) AS distinct_ids,
  CAST(max(count(*) - count(effective), count(*) - count(received)) AS BIGINT) AS most_nulls,
  count(*) FILTER (coalesce(received < published, FALSE) OR coalesce(opened < received, FALSE) OR coalesce(effective < received, FALSE)
    OR coalesce(opened < published, FALSE) OR coalesce(effective < published, FALSE)) AS temporal_anomalies,
  count(*) FILTER (base_price < 0) AS negative_prices, count(*) FILTER (duration < 0) AS negative_durations FROM P""").replace(
    "CAST(max(count(*) - count(effective), count(*) - count(received)) AS BIGINT)",
    "greatest(" + ", ".join(f"count(*) - count({c})" for c in P_COLUMNS) + ")"))
def _(spark, sf):
    return report.run_summary(processes(spark, sf), SPEC)


@query("run_summary_tests", with_p("""
SELECT n_rows, conversions_lost, tests_run, significant_tests FROM
  (SELECT count(*) AS n_rows, count(duration_unit) - count(TRY_CAST(duration_unit AS DOUBLE)) AS conversions_lost FROM P),
  (SELECT count(p) AS tests_run, count(*) FILTER (p < 0.05) AS significant_tests FROM (
    SELECT exp(-(n - e) * (n - e) / e / 2) AS p FROM (
      SELECT n, sum(n) OVER (PARTITION BY segment) * sum(n) OVER (PARTITION BY mode) / CAST(sum(n) OVER () AS DOUBLE) AS e
      FROM (SELECT segment, mode, count(*) AS n FROM P GROUP BY 1, 2))))"""))
def _(spark, sf):
    rows = processes(spark, sf)
    lost = C.conversion_summary(rows, {"duration_unit": ("numeric", N.to_number(F.col("duration_unit")))})
    cells = rows.groupBy("segment", "mode").agg(F.count(F.lit(1)).alias("n"))
    both = cells.join(F.broadcast(cells.groupBy("segment").agg(F.sum("n").alias("row_n"))), "segment").join(F.broadcast(cells.groupBy("mode").agg(F.sum("n").alias("col_n"))), "mode")
    expected = F.col("row_n") * F.col("col_n") / cells.agg(F.sum("n")).scalar().cast("double")
    gap = F.col("n") - expected
    tests = both.select(F.exp(-gap * gap / expected / 2).alias("p_value"))
    return report.run_summary(rows, SPEC, lost, tests).select("n_rows", "conversions_lost", "tests_run", "significant_tests")


@query("quality_report")
def _(spark, sf):
    return report.quality_report(duplicated(spark, sf), SPEC, nfkc=False)

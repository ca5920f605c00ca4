"""Sinks, streams and the registered queries."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from assayer.plans.score import score
from assayer.sources import scan, sinks
from assayer.streaming import read_stream, score_stream
from assayer.workload.fixtures import SPEC, processes, table

SF = "/root/testdata/sf0.001"


def test_round_trips(spark, tmp_path):
    df = table(spark, SF, "nation")
    assert spark.read.parquet(sinks.save_parquet(df, str(tmp_path / "p"))).exceptAll(df).count() == 0
    back = spark.read.csv(sinks.save_csv(df, str(tmp_path / "c"), single_file=True), header=True)
    assert back.count() == 25
    text = next(Path(tmp_path / "c").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("﻿n_nationkey")
    assert spark.read.json(sinks.save_json(df, str(tmp_path / "j"))).count() == 25
    summary = sinks.nested_summary(spark, {"a": df.agg(F.count("*").alias("n")), "b": df.agg(F.max("n_nationkey").alias("m"))}).first()[0]
    assert summary == '{"a":{"n":25},"b":{"m":24}}'


def test_relational_table(spark):
    url = "jdbc:derby:memory:assayer;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = table(spark, SF, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.save_table(df, url, "orders_copy", driver)
    row = sinks.validate_load(df, url, "orders_copy", driver).first()
    assert row["matches"] and row["source_rows"] == df.count()
    assert sinks.table_ddl(df, "t") == 'CREATE TABLE t ("o_orderkey" BIGINT, "o_totalprice" DOUBLE PRECISION, "o_orderstatus" TEXT)'


def test_window_filter_reaches_the_scan(spark):
    kept = scan.window_filter(table(spark, SF, "orders"), "o_orderdate", 1, dt.date(1999, 6, 30))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan


def test_scores_on_a_stream(spark, tmp_path):
    rows = processes(spark, SF)
    source = sinks.save_parquet(rows, str(tmp_path / "in"))
    stream = read_stream(spark, source, rows.schema)
    score_stream(stream, SPEC, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out")).select("proc_id", "quality_score", "label_confidence")
    assert streamed.exceptAll(score(rows, SPEC).select("proc_id", "quality_score", "label_confidence")).count() == 0
    assert streamed.count() == rows.count()


def test_entry(spark):
    assert entry(spark).count() == 1500


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def cell(value):
    return f"{value:.5g}" if isinstance(value, float) else repr(value)


CHECKED = (
    "normalize_token", "multivalue_text", "to_numeric", "day_deltas", "price_extreme_flag", "clean_pipeline", "dedup_logical", "label_confidence",
    "numeric_profile", "low_variability", "key_duplicates", "datetime_profile", "column_audit", "holm_adjust", "mann_whitney", "levene_stat",
    "chi_square", "spearman_pairs", "ols_fit", "key_findings",
)


@pytest.mark.parametrize("key", CHECKED)
def test_query_equals_check_sql(spark, database, key):
    frame = queries()[key](spark, SF)
    result = database.execute(oracle_sql()[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    want = sorted(tuple(cell(r[names.index(c)]) for c in sorted(names)) for r in result.fetchall())
    got = sorted(tuple(cell(r[c]) for c in sorted(names)) for r in frame.collect())
    assert got == want


def test_every_check_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())

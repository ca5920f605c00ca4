"""A task's share of the lines, which aggregates of orders follow."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from assayer.session import configure
from assayer.workload import fixtures

SF = "/root/testdata/sf0.001"


def test_lines_are_dealt_by_order_before_they_are_aggregated(spark, monkeypatch):
    """One exchange, no aggregate below it, and as many partitions as the rows ask for beyond the session's number."""
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 500)
    configure(spark)
    plain = spark.read.parquet(f"{SF}/lineitem.parquet")
    pieces = -(-plain.count() // 500)
    assert pieces > int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = fixtures._lines(spark, SF, {"n_lines", "n_suppliers", "n_returned"})
    plan = lines._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#\w+, (\d+)\)", plan)
    assert dealt == [("l_orderkey", str(pieces))] and plan.count("Exchange") == 1
    assert "Aggregate" not in plan[plan.index("Exchange"):]

    expected = plain.groupBy("l_orderkey").agg(
        F.count(F.lit(1)), F.count_distinct("l_suppkey"), F.count_if(F.col("l_returnflag") == "R"))
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, expected.collect()))


def test_few_lines_leave_their_partitions_to_the_session(spark):
    configure(spark)
    plan = fixtures._lines(spark, SF, {"n_lines"})._jdf.queryExecution().executedPlan().toString()
    number = spark.conf.get("spark.sql.shuffle.partitions")
    assert re.findall(r"Exchange hashpartitioning\(l_orderkey#\w+, (\d+)\)", plan) == [number]


def test_file_splits_hold_16_mb(spark):
    """Partial aggregates of whole rows, as in deduplication, take about ten times their split's bytes."""
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        configure(spark)
        assert int(spark.conf.get("spark.sql.files.maxPartitionBytes")) <= 16 << 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)

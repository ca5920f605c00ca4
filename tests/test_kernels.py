"""Quantiles and ranks against brute force, with settings that force the distributed paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.operators.kernels import attach_by_value, exact_quantiles, frequencies, running_counts, value_ranks


def skewed(n=4000):
    rng = np.random.default_rng(3)
    values = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.lognormal(3, 2, n), 3))
    keys = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n)).tolist()
    return [(None if k == "c" else k, float(v)) for k, v in zip(keys, values, strict=True)]


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_quantiles_are_exact_whatever_the_sketch(spark, accuracy):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    probs = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p995": 0.995}
    overall = exact_quantiles(df, ["v"], probs, accuracy=accuracy).first()
    values = [v for _, v in rows]
    for name, p in probs.items():
        assert overall[name] == pytest.approx(np.quantile(values, p), rel=1e-12)
    for row in exact_quantiles(df, ["v"], probs, ["k"], accuracy).collect():
        group = [v for k, v in rows if k == row["k"]]
        assert row["n"] == len(group)
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(group, p), rel=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0])), min_size=1, max_size=60))
def test_quantiles_on_arbitrary_values(spark, values):
    present = [v for v in values if v is not None]
    found = exact_quantiles(spark.createDataFrame([(v,) for v in values], "v double"), ["v"], {"a": 0.1, "b": 0.5, "c": 0.9}, accuracy=8).collect()
    if not present:
        assert found == []
        return
    for name, p in (("a", 0.1), ("b", 0.5), ("c", 0.9)):
        assert found[0][name] == pytest.approx(np.quantile(present, p), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("size", [1, 2, 3, 41, 81, 500])
def test_quantiles_of_small_groups(spark, size):
    values = np.round(np.random.default_rng(size).lognormal(0, 2, size), 2).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for accuracy in (10, 100, 10_000):
        found = exact_quantiles(df, ["v"], {"a": 0.005, "b": 0.5, "c": 0.995}, accuracy=accuracy).first()
        assert [found[x] for x in "abc"] == pytest.approx(np.quantile(values, [0.005, 0.5, 0.995]).tolist())


def test_ordered_rows_do_not_grow_with_the_table(spark):
    """Ten times the rows, as many rows to order; values as numpy gives them, also around a value that many rows share."""
    from assayer.operators.kernels import ordered_values

    probs = {"p01": 0.01, "p50": 0.5, "p99": 0.99}
    lengths = []
    for size in (20_000, 200_000):
        random = np.random.default_rng(size)
        values = np.where(random.random(size) < 0.3, 5.0, random.lognormal(1.5, 1, size))
        df = spark.createDataFrame(pd.DataFrame({"k": ["x"] * size, "v": values})).repartition(4)
        found = exact_quantiles(df, ["v"], probs, ["k"], accuracy=1000, ordered_rows=25).first()
        assert [found[p] for p in probs] == pytest.approx(np.quantile(values, list(probs.values())).tolist(), rel=1e-12)
        assert found["n"] == size
        lengths.append(ordered_values(df, ["v"], list(probs.values()), ["k"], 1000, False, 25).count())
    assert max(lengths) <= 3 * 2 * 25 + 4, lengths
    everything = ordered_values(df, ["v"], list(probs.values()), ["k"], 1000, False, 10**9).count()
    assert everything > 20 * max(lengths)


def _average_ranks(values):
    order = np.sort(values)
    return {v: (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2 for v in set(values)}


@pytest.mark.parametrize("range_rows", [25, 1_000_000])
def test_ranks_in_ranges_equal_global_ranks(spark, range_rows):
    rows = skewed()
    counts = spark.createDataFrame(rows, "k string, value double").fillna("none").groupBy("k", "value").agg(F.count("*").alias("n"))
    ranks = value_ranks(counts, ["k"], range_rows=range_rows).collect()
    for key in ("hot", "a", "b", "none"):
        expected = _average_ranks([v for k, v in rows if (k or "none") == key])
        assert {r["value"]: r["avg_rank"] for r in ranks if r["k"] == key} == pytest.approx(expected)


def test_running_counts_of_several_columns(spark):
    rows = [(i % 50, int(i % 3 == 0), int(i % 3 != 0)) for i in range(300)]
    wide = spark.createDataFrame(rows, "value int, a int, b int").groupBy("value").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("key", F.lit(1))
    for row in running_counts(wide, ["key"], ["a", "b"], range_rows=10).collect():
        assert row["below_a"] == sum(a for v, a, _ in rows if v < row["value"])
        assert row["below_b"] == sum(b for v, _, b in rows if v < row["value"])


def test_rank_lookup_keeps_every_row(spark):
    rows = spark.createDataFrame([("p", float(v if v > 300 else 0), i) for i, v in enumerate(range(1000))], "pair string, x double, i int")
    counts = rows.groupBy("pair", "x").agg(F.count("*").alias("n")).withColumnRenamed("x", "value")
    ranks = value_ranks(counts, ["pair"]).withColumn("total", F.lit(1000)).withColumnRenamed("value", "x")
    joined = attach_by_value(rows, ranks, ["pair"], "x", share=10)
    assert joined.count() == 1000
    assert joined.filter("x = 0").select("avg_rank").distinct().first()[0] == 151.0


def test_frequencies_keep_nulls(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), ("a", 2)], "x string, y int")
    got = {(r["column"], r["value"], r["n"]) for r in frequencies(df, ["x", "y"]).collect()}
    assert got == {("x", "a", 2), ("x", None, 1), ("y", "1", 2), ("y", "2", 1)}

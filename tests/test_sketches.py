"""Stored sketches against exact figures."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import functions as F

from assayer.operators import sketches as S

SF = "/root/testdata/sf0.01"


def test_merged_sketches_are_within_their_bounds(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("day"), "l_orderkey", "l_returnflag",
        F.when(F.col("l_quantity") > 3, F.col("l_extendedprice")).alias("price"), F.lit(None).cast("double").alias("none"),
    )
    place = str(tmp_path / "s")
    for part in (F.col("day").isNull(), F.col("day") < 4, F.col("day") >= 4):  # written in three goes
        S.sketches(rows.where(part), ["day"], ["l_orderkey", "l_returnflag"], ["price", "none"]).write.mode("append").parquet(place)
    stored = spark.read.parquet(place)
    assert stored.count() == 7
    single = S.sketches(rows, [], ["l_orderkey", "l_returnflag"], ["price", "none"])
    exact = rows.agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("k"), F.countDistinct("price").alias("p")).first()
    prices = sorted(r[0] for r in rows.where("price IS NOT NULL").select("price").collect())
    for source in (stored, single, S.merge_sketches(stored, ["day"])):
        got = {r["column"]: r for r in S.sketch_profile(source, (0.1, 0.5, 0.99)).collect()}
        assert got["l_returnflag"]["distinct_estimate"] == 3 and got["l_returnflag"]["p50"] is None
        assert abs(got["l_orderkey"]["distinct_estimate"] / exact["k"] - 1) <= S.DISTINCT_ERROR
        assert abs(got["price"]["distinct_estimate"] / exact["p"] - 1) <= S.DISTINCT_ERROR
        assert (got["price"]["min"], got["price"]["max"]) == (prices[0], prices[-1])
        assert got["price"]["non_null_count"] == len(prices) and got["price"]["null_count"] == exact["n"] - len(prices)
        for q, name in ((0.1, "p10"), (0.5, "p50"), (0.99, "p99")):
            low, high = bisect_left(prices, got["price"][name]), bisect_right(prices, got["price"][name])
            assert low - S.QUANTILE_ERROR * len(prices) <= q * len(prices) <= high + S.QUANTILE_ERROR * len(prices)
        assert got["none"]["non_null_count"] == 0 and got["none"]["distinct_estimate"] == 0 and got["none"]["p50"] is None


def test_no_rows(spark):
    empty = spark.createDataFrame([], "day int, name string, x double")
    for by in ([], ["day"]):
        got = {r["column"]: r for r in S.sketch_profile(S.sketches(empty, by, ["name"], ["x"])).collect()}
        assert got["x"]["distinct_estimate"] == 0 and got["x"]["p50"] is None and got["name"]["null_count"] == 0

"""Sizes that a task's memory follows."""

from __future__ import annotations

from assayer.session import MOST_BYTES, configure


def test_task_sizes_are_bounded(spark):
    """Larger settings come down to the bound, also Spark's defaults; a smaller one of the session stays."""
    kept = {key: spark.conf.get(key) for key in MOST_BYTES}
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    try:
        for key in MOST_BYTES:
            spark.conf.set(key, "1g")
        configure(spark)
        assert {key: size(spark.conf.get(key)) for key in MOST_BYTES} == MOST_BYTES
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
        configure(spark)
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "64k"
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)

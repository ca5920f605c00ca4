"""Facts of the quality report: constants need no least and greatest texts."""

from __future__ import annotations

from assayer.plans.report import _facts
from assayer.workload.fixtures import SPEC

SCHEMA = "proc_id string, same string, none string, holes string, nan double, varied int"


def _constants(df):
    facts = _facts(df, "s", SPEC)
    return facts, {r["item"] for r in facts.where("section = 'constant'").collect()}


def test_constants_are_counted_in_a_hash_aggregate(spark):
    df = spark.createDataFrame([("a", "x", None, None if i % 2 else "y", float("nan"), i) for i in range(8)], SCHEMA).repartition(3)
    facts, found = _constants(df)
    assert found == {"proc_id", "same", "none", "nan"}
    assert "SortAggregate" not in facts._jdf.queryExecution().executedPlan().toString()
    assert _constants(df.where("varied < 0"))[1] == set(df.columns)

"""Text is rewritten once a row: thresholds, days and reports add no text work of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.functions import text as X
from assayer.operators import derive as D
from assayer.spec import DURATION_UNITS, NOT_APPLICABLE_LABEL, UNKNOWN_UNIT_LABEL
from assayer.workload.fixtures import SPEC


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_days_of_canonical_units_are_a_look_up(spark):
    units = [*DURATION_UNITS, NOT_APPLICABLE_LABEL, UNKNOWN_UNIT_LABEL, None]
    df = spark.createDataFrame([(2.0 if i % 2 else None, u) for i, u in enumerate(units * 3)], "duration double, duration_unit string")
    unit = F.col("duration_unit")
    assert all(a == b and c == d for a, b, c, d in df.select(
        X.days_of_unit(unit), X.unit_days(unit), X.duration_unit(unit, normalized=True), X.duration_unit(unit)).collect())
    wanted = sorted(map(str, D.with_duration(df, SPEC).collect()))
    found = D.with_duration(df, SPEC, df, canonical=True)
    assert sorted(map(str, found.collect())) == wanted
    assert "regexp" not in _plan(found).lower() and "rlike" not in _plan(found).lower()


def test_uneven_text_is_rewritten_once(spark):
    texts = ["", " ", "　\t", "a", " a", "a ", "a  b", "a\tb", "a\x1f", " é  é ", "é", "x y", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(X.normalize_text(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == [" ".join(t.split()) or None if t is not None else None for t in texts]
    assert _plan(got).count("regexp_replace") == 1


def test_lists_of_one_piece(spark):
    texts = ["a", "[a]", "[a", "a]", "a, b, a", ",", "[]", "[", "]", " a ", "a,", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.multivalue_text(F.col("t")).alias("m"))
    assert [r.m for r in got.collect()] == ["a", "a", "[a", "a]", "a, b", None, None, "[", "]", "a", "a", None]

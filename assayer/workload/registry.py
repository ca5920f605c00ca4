"""Query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def presented(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, so that summation order does not show; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(F.col(f.name), DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _presented_sql(sql: str, doubles: str) -> str:
    names = doubles.split()
    if not names:
        return sql
    items = ", ".join(f"round(CAST({n} AS DOUBLE), {DIGITS}) + 0.0 AS {n}" for n in names)
    return f"SELECT * REPLACE ({items}) FROM (\n{sql}\n) AS presented"


DEFERRED: dict[str, tuple[Callable[[], str], str]] = {}


def query(key: str, sql: str | None = None, doubles: str = "", deferred: Callable[[], str] | None = None):
    """Register a query; ``doubles`` lists the floating-point columns of the check SQL, ``deferred`` builds it once all are registered."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presented(function(configure(spark), sf_dir))

        run.__name__ = key
        if key in QUERIES:
            raise ValueError(f"query registered twice: {key}")
        QUERIES[key] = run
        if deferred is not None:
            DEFERRED[key] = deferred, doubles
        if sql is not None:
            ORACLES[key] = _presented_sql(sql, doubles)
        return function

    return register


def complete() -> None:
    """Build the check SQL that needs other modules' pieces."""
    for key, (build, doubles) in DEFERRED.items():
        ORACLES[key] = _presented_sql(build(), doubles)

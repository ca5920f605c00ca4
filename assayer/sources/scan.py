"""Scans, date windows, windowed extraction and the input contract."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.numbers import finite, to_number, to_timestamp
from assayer.session import configure


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a table on storage."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.getContentSummary(hadoop).getLength()


def load(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet scan; a column list is pushed down as the read schema. Splits follow ``spark.sql.files.*`` alone."""
    df = configure(spark).read.parquet(path)
    return df.select(*columns) if columns else df


def date_window(years: int, today: dt.date | None = None) -> tuple[Column, Column]:
    """Bounds of the last ``years`` years, ending at midnight UTC of ``today``."""
    end = F.lit(today) if today else F.current_date()
    return F.add_months(end, -12 * years).cast("timestamp"), end.cast("timestamp")


def window_filter(df: DataFrame, column: str, years: int, today: dt.date | None = None) -> DataFrame:
    """Rows whose date lies in the window, bounds included; the filter reaches the Parquet scan."""
    start, end = date_window(years, today)
    kind = df.schema[column].dataType.typeName()
    return df.filter(F.col(column).between(start.cast(kind), end.cast(kind)))


def capped_extract(df: DataFrame, order: Sequence[str], max_rows: int) -> DataFrame:
    """First ``max_rows`` rows in the given order (a bounded top-k, not a global sort)."""
    return df.orderBy(*order).limit(max_rows)


def validated_window(df: DataFrame, column: str, start: str, end: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Coerce the date column, keep the inclusive window, sort ascending."""
    if column not in df.columns:
        raise ValueError(f"required date column is missing: {column}")
    coerced = df.withColumn(column, to_timestamp(F.col(column)))
    kept = coerced.filter(F.col(column).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return kept.orderBy(column, *tie_break)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"required columns are missing: {missing}")


def enforce_contract(
    df: DataFrame,
    required: Sequence[str],
    dates: Sequence[str] = (),
    numbers: Sequence[str] = (),
    flags: Sequence[str] = (),
) -> DataFrame:
    """Check that required columns exist and coerce dates, numbers and flags in one projection."""
    require_columns(df, required)
    changes = {c: to_timestamp(F.col(c)) for c in dates if c in df.columns}
    for name in (c for c in numbers if c in df.columns):
        text = df.schema[name].dataType.typeName() == "string"
        changes[name] = to_number(F.col(name)) if text else finite(F.col(name))
    for name in (c for c in flags if c in df.columns):
        changes[name] = F.coalesce(F.col(name).cast("boolean"), F.lit(False))
    return df.withColumns(changes) if changes else df

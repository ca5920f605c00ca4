"""Sinks: Parquet, CSV and JSON result files, and relational tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def save_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def save_csv(df: DataFrame, path: str, bom: bool = True, single_file: bool = False) -> str:
    """Result table as CSV with a header.

    The byte-order mark goes in front of the first header name. ``single_file``
    is meant for tables with one row per column, pair or term.
    """
    named = df.withColumnRenamed(df.columns[0], BOM + df.columns[0]) if bom and df.columns else df
    target = named.coalesce(1) if single_file else named
    target.write.mode("overwrite").option("header", True).csv(path)
    return path


def save_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def nested_summary(spark: SparkSession, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One JSON document from one-row summary tables, e.g. the before/after report."""
    fields = [part.select(F.struct(*part.columns)).scalar().alias(name) for name, part in parts.items()]
    return spark.range(1).select(F.to_json(F.struct(*fields)).alias("summary"))


# Relational types by Spark type.
SQL_TYPES = {
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "byte": "BIGINT",
    "short": "BIGINT",
    "integer": "BIGINT",
    "long": "BIGINT",
    "float": "DOUBLE PRECISION",
    "double": "DOUBLE PRECISION",
    "boolean": "BOOLEAN",
}


def sql_type(kind: T.DataType) -> str:
    return SQL_TYPES.get(kind.typeName(), "TEXT")


def table_ddl(df: DataFrame, table: str) -> str:
    """CREATE TABLE statement with the mapped types, for databases loaded by other tools."""
    columns = ", ".join(f'"{f.name}" {sql_type(f.dataType)}' for f in df.schema.fields)
    return f"CREATE TABLE {table} ({columns})"


def save_table(
    df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None, partitions: int | None = None
) -> str:
    """Drop, create and bulk-load a relational table over JDBC, in parallel batches."""
    wide = df.select(*[
        F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() in ("byte", "short", "integer")
        else F.col(f.name)
        for f in df.schema.fields
    ])
    writer = wide.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", table)
    for key, value in {"batchsize": "10000", **(properties or {})}.items():
        writer = writer.option(key, value)
    if partitions:
        writer = writer.option("numPartitions", partitions)
    writer.save()
    return table


def validate_load(
    df: DataFrame, url: str, table: str, properties: Mapping[str, str] | None = None
) -> DataFrame:
    """Source rows against rows in the table; both counted where the data is."""
    reader = df.sparkSession.read.format("jdbc").option("url", url)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    loaded = reader.option("query", f"SELECT COUNT(*) AS loaded_rows FROM {table}").load().toDF("loaded_rows")
    source = df.agg(F.count(F.lit(1)).alias("source_rows"))
    counted = source.withColumn("loaded_rows", loaded.select(F.col("loaded_rows").cast("long")).scalar())
    return counted.withColumn("matches", F.col("source_rows") == F.col("loaded_rows"))


def stringify(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every column as text except those kept, the form the raw load uses."""
    return df.select(*[
        F.col(c) if c in keep else F.col(c).cast("string").alias(c) for c in df.columns
    ])

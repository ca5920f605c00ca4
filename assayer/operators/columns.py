"""Column-level decisions: names, roles, contract, audit, semantic groups, recommendations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.numbers import finite, to_timestamp
from assayer.functions.text import normalize_column_name
from assayer.operators.profile import cardinality, low_variability, null_profile, pct, text_columns, wide_to_rows
from assayer.plans.clean import coerce
from assayer.sources.scan import require_columns
from assayer.spec import HIGH_NULL_PCT, NEAR_CONSTANT_PCT, Spec

DATE_CANDIDATE_SHARE = 0.5


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalize_column_name(c) for c in df.columns])


def drop_required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the columns; naming one that is not there is an error."""
    require_columns(df, columns)
    return df.drop(*columns)


def role_drop(df: DataFrame, spec: Spec) -> DataFrame:
    """Drop leakage, low-variability, redundant and almost-empty columns where present."""
    return df.drop(*[c for c in spec.dropped if c in df.columns])


def expected_kind(name: str, spec: Spec) -> str:
    return "timestamp" if name in spec.dates else "double" if name in spec.numeric else "string"


def contract_check(df: DataFrame, spec: Spec) -> DataFrame:
    """Required columns with their expected type and the nulls left after coercion."""
    required = spec.required()
    require_columns(df, required)

    def coerced(name: str) -> Column:
        kind = expected_kind(name, spec)
        if kind == "timestamp":
            return to_timestamp(F.col(name))
        return finite(F.col(name)) if kind == "double" else F.col(name).cast("string")

    return wide_to_rows(df, {
        c: {"expected_type": F.lit(expected_kind(c, spec)), "null_count": F.count_if(coerced(c).isNull())} for c in required
    })


ROLE_RULES = {
    "leakage": "dropped: known only after the outcome",
    "low_variability": "dropped: constant or nearly so",
    "redundant": "dropped: repeats another column",
    "almost_empty": "dropped: almost no values",
    "traceability": "kept for tracing only",
    "transformed": "kept after normalisation or coercion",
    "keep": "kept as it is",
}


def column_role(name: str, spec: Spec) -> str | None:
    """Role fixed by the spec; None leaves it to the data (transformed or kept)."""
    for role in ("leakage", "low_variability", "redundant", "almost_empty", "traceability"):
        if name in getattr(spec, role):
            return role
    return None


def column_audit(df: DataFrame, spec: Spec, nfkc: str | bool = "auto") -> DataFrame:
    """Per column: role, rule, and how many cells the coercion changed. One aggregate over the table."""
    both = coerce(df.withColumn("__raw", F.struct(*df.columns)), spec, nfkc)
    kinds = {f.name: f.dataType for f in both.schema.fields}

    def changed(name: str) -> Column:
        return ~F.col("__raw")[name].try_cast(kinds[name]).eqNullSafe(F.col(name))

    rows = wide_to_rows(both, {
        c: {"fixed_role": F.lit(column_role(c, spec)).cast("string"), "cells_changed": F.count_if(changed(c))} for c in df.columns
    })
    role = F.coalesce("fixed_role", F.when(F.col("cells_changed") > 0, "transformed").otherwise("keep"))
    rules = F.create_map(*[F.lit(x) for pair in ROLE_RULES.items() for x in pair])
    return rows.select("column", role.alias("role"), F.try_element_at(rules, role).alias("rule"), "cells_changed")


def binary_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns whose values all lie in {0, 1} and that hold at least one value."""
    rows = wide_to_rows(df, {
        c: {"non_null_count": F.count(c), "inside": F.coalesce(F.every(F.col(c).cast("double").isin(0.0, 1.0)), F.lit(False))} for c in columns
    })
    return rows.select("column", "non_null_count", (F.col("inside") & (F.col("non_null_count") > 0)).alias("is_binary_like"))


def date_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns by the share of their values that read as a timestamp; bare numbers are codes, not years."""
    names = list(columns or text_columns(df))
    rows = wide_to_rows(df, {
        c: {"non_null_count": F.count(c), "parsed": F.count(F.when(F.col(c).rlike("[0-9][-/:][0-9]"), to_timestamp(F.col(c))))} for c in names
    })
    share = F.when(F.col("non_null_count") > 0, F.col("parsed") / F.col("non_null_count")).otherwise(0.0)
    return rows.select("column", "non_null_count", "parsed", pct(share, F.lit(1)).alias("parsed_pct"), (share >= DATE_CANDIDATE_SHARE).alias("is_candidate"))


def column_groups(df: DataFrame, spec: Spec) -> dict[str, str]:
    """Semantic group of each column. Types decide first; only 0/1 columns need a look at the data (one row)."""
    groups: dict[str, str] = {}
    numbers: list[str] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            groups[f.name] = "datetime"
        elif isinstance(f.dataType, T.BooleanType):
            groups[f.name] = "boolean"
        elif isinstance(f.dataType, T.NumericType):
            numbers.append(f.name)
        elif f.name == spec.description:
            groups[f.name] = "text"
        elif f.name in spec.traceability:
            groups[f.name] = "technical"
        else:
            groups[f.name] = "categorical"
    if numbers:
        inside = df.agg(*[F.every(F.col(c).cast("double").isin(0.0, 1.0)).alias(c) for c in numbers]).first()
        groups |= {c: "binary_numeric" if inside[c] else "numeric" for c in numbers}
    return {c: groups[c] for c in df.columns}


GROUPS = ("datetime", "numeric", "binary_numeric", "boolean", "categorical", "text", "technical")


def group_sizes(df: DataFrame, spec: Spec) -> dict[str, int]:
    found = list(column_groups(df, spec).values())
    return {g: found.count(g) for g in GROUPS}


def group_table(df: DataFrame, spec: Spec) -> DataFrame:
    rows = [(i, c, df.schema[c].dataType.simpleString(), g) for i, (c, g) in enumerate(column_groups(df, spec).items(), start=1)]
    return df.sparkSession.createDataFrame(rows, "column_position int, column string, dtype string, semantic_group string")


def role_names(spec: Spec) -> dict[str, list[str]]:
    """Roles each column plays, e.g. ``published`` or ``price``."""
    names: dict[str, list[str]] = {}
    for role in ("id", "reference", "portfolio", "url", "description", "category", "price", "mode", "type", "state",
                 "published", "received", "opened", "effective", "latest", "duration", "duration_unit", "suppliers"):
        column = getattr(spec, role)
        if column:
            names.setdefault(column, []).append(role)
    return names


def inventory(df: DataFrame, spec: Spec) -> DataFrame:
    """Position, type, semantic group, roles, nulls and distinct values of every column."""
    roles = role_names(spec)
    labels = [(c, " | ".join(roles.get(c, [])) or "none") for c in df.columns]
    named = df.sparkSession.createDataFrame(labels, "column string, roles string")
    nulls = null_profile(df).select("column", "non_null_count", "null_count", "null_pct")
    levels = cardinality(df).select("column", "distinct_values")
    base = group_table(df, spec).join(F.broadcast(named), "column")
    return base.join(F.broadcast(nulls), "column").join(F.broadcast(levels), "column").withColumn("has_role", F.col("roles") != "none")


def recommendations(df: DataFrame, spec: Spec, columns: Sequence[str] | None = None) -> DataFrame:
    """Labels per column from the null and variability profiles and the leakage list."""
    nulls = null_profile(df, columns).select("column", "null_pct")
    shares = low_variability(df, columns).select("column", "dominant_share_pct")
    leakage = df.sparkSession.createDataFrame([(c, True) for c in spec.leakage], "column string, leak boolean")
    joined = nulls.join(shares, "column", "full").join(leakage, "column", "full")
    null_pct = F.coalesce("null_pct", F.lit(0.0))
    labels = F.array_compact(F.array(
        F.when(null_pct > HIGH_NULL_PCT, "high_nulls"),
        F.when(F.col("dominant_share_pct") >= NEAR_CONSTANT_PCT, "near_constant"),
        F.when(F.col("leak"), "potential_leakage"),
        F.when(F.col("column") == spec.id, "primary_identifier"),
        F.when(F.col("column") == (spec.reference or ""), "non_unique_reference_identifier"),
    ))
    return joined.select(
        "column", null_pct.alias("null_pct"), "dominant_share_pct", F.size(labels).alias("recommendation_count"),
        F.when(F.size(labels) > 0, F.array_join(labels, " | ")).otherwise("ok").alias("recommendations"),
    ).orderBy(F.desc("recommendation_count"), F.desc("null_pct"), F.desc("dominant_share_pct"), "column")


def conversion_summary(df: DataFrame, conversions: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Values before and after each conversion; ``conversions`` maps column to (kind, converted expression)."""
    rows = wide_to_rows(df, {
        c: {"conversion_type": F.lit(kind), "non_null_before": F.count(c), "non_null_after": F.count(expression)}
        for c, (kind, expression) in conversions.items()
    })
    before, after = F.col("non_null_before"), F.col("non_null_after")
    return rows.select(
        "column", "conversion_type", "non_null_before", "non_null_after", F.greatest(before - after, F.lit(0)).alias("coerced_to_null"),
        F.when(before > 0, F.round(after * F.lit(100.0) / before, 2)).otherwise(0.0).alias("parse_success_pct"),
    )


def dependency_check(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """Does ``determinant`` fix ``dependent``? Works on distinct pairs, so hot keys stay small."""
    pairs = df.groupBy(determinant, dependent).agg(F.count(F.lit(1)).alias("c"))
    groups = pairs.groupBy(determinant).agg(F.count(dependent).alias("levels"), F.sum("c").alias("c"))
    equal = F.sum(F.when(F.col(determinant).cast("string").eqNullSafe(F.col(dependent).cast("string")), F.col("c")).otherwise(0))
    rate = pairs.agg((equal / F.sum("c")).alias("r")).scalar()
    return groups.agg(
        F.lit(f"{determinant} -> {dependent}").alias("dependency"), F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("levels") > 1).alias("violating_groups"), F.max("levels").alias("max_levels"),
        (F.count_if(F.col("levels") > 1) == 0).alias("holds"),
    ).withColumn("equal_rate", rate)

"""Descriptive plan: every profile of one table, from one written base."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.numbers import finite
from assayer.operators import columns as C
from assayer.operators import dedup
from assayer.operators import profile as A
from assayer.session import materialise
from assayer.spec import Spec


def describe(
    df: DataFrame, spec: Spec, keys: Sequence[Sequence[str]] | None = None, entities: Sequence[str] = (), top_n: int = 10,
) -> dict[str, DataFrame]:
    """Result tables by name. The table is written once with NaN as null; its columns are grouped by type, then by role.

    ``keys``: column sets whose repeats are counted, by default the identifiers; ``entities``: columns to count processes by.
    """
    base = materialise(df.select(*[A.present(df, c).alias(c) for c in df.columns]))
    kinds = C.column_groups(base, spec)
    of = {g: [c for c, k in kinds.items() if k == g] for g in C.GROUPS}
    identifiers = [c for c in (spec.id, spec.reference) if c in base.columns]
    keys = [[c] for c in identifiers] if keys is None else keys
    numeric = [*of["numeric"], *of["binary_numeric"]]
    levels = [*of["categorical"], *of["boolean"]]
    results = {
        "overview": A.overview(base, identifiers, {g: len(v) for g, v in of.items()}),
        "inventory": C.inventory(base, spec), "null_profile": A.null_profile(base), "expanded_nulls": A.expanded_nulls(base),
        "cardinality": A.cardinality(base), "low_variability": A.low_variability(base), "exact_duplicates": dedup.exact_duplicate_count(base),
        "recommendations": C.recommendations(base, spec),
    }
    if keys:
        results["key_duplicates"] = dedup.duplicate_summary(base, keys)
    if numeric:
        results["numeric_profile"] = A.numeric_profile(base, {c: finite(F.col(c)) for c in numeric})
    if levels:
        results |= {
            "categorical_profile": A.categorical_profile(base, levels), "top_values": A.top_values(base, levels, top_n), "mode": A.mode_value(base, levels),
        }
    if of["datetime"]:
        results |= {"datetime_profile": A.datetime_profile(base, of["datetime"]), "year_counts": A.period_counts(base, of["datetime"], "yyyy")}
    if of["text"]:
        results["text_quality"] = A.text_quality(base, of["text"])
    results |= {f"entities_by_{e}": A.top_values(base, [e], top_n, keep_nulls=True) for e in entities}
    if spec.price in base.columns:
        for group in (c for c in (spec.price_group, spec.mode) if c in base.columns):
            results[f"price_by_{group}"] = A.numeric_by_group(base, spec.price, group, keep_null_group=True)
    if spec.state in base.columns and spec.mode in base.columns:
        results["state_by_mode"] = A.crosstab_long(base, spec.mode, spec.state)
    return results

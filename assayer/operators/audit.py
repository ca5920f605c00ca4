"""What cleaning did, kept in the cleaned rows: a bit for each changed cell, and the rows that each kept row stands for.

Marks are set where raw and cleaned values are side by side, before anything is shuffled, and both deduplications carry them as a few
numbers a row. The audit reads the cleaned table alone; the raw table is not scanned or joined again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import text as X
from assayer.spec import Spec

KINDS = ("unreadable", "placeholder", "rewritten", "negative", "unit")
WORD_BITS = 63  # columns in one long
CELLS = 4  # cells whose marks one expression computes
RAW, PARTS, RAW_ROWS, DISTINCT_ROWS = "__raw", "__parts", "raw_rows", "distinct_rows"


def mark_names(columns: Sequence[str]) -> list[str]:
    words = range(-(-len(columns) // WORD_BITS))
    return [f"changed_{kind}_{w}" for kind in KINDS for w in words]


def _cell_kinds(df: DataFrame, name: str, spec: Spec) -> dict[str, Column]:
    """Condition of each kind for one column; at most one holds in a cell. NaN and null are the same absence."""
    raw, value, kind = F.col(RAW)[name], F.col(name), df.schema[name].dataType
    before = raw.isNotNull()
    if isinstance(df.schema[RAW].dataType[name].dataType, (T.DoubleType, T.FloatType)):
        before = before & ~F.isnan(raw)
    if name == spec.duration_unit:
        return {"unit": ~raw.eqNullSafe(X.duration_unit(value, normalized=True))}
    typed = name in spec.dates or name in spec.numeric
    out = {"unreadable" if typed else "placeholder": before & value.isNull(), "rewritten": before & value.isNotNull() & ~raw.try_cast(kind).eqNullSafe(value)}
    if name in (spec.price, spec.duration, *spec.counters):
        out["negative"] = F.coalesce(value < 0, F.lit(False))
        out["rewritten"] = out["rewritten"] & ~out["negative"]
    return out


def with_marks(coerced: DataFrame, columns: Sequence[str], spec: Spec) -> DataFrame:
    """``coerced`` holds the raw row in RAW and amounts that may still be negative; RAW gives way to the marks."""
    bits: dict[str, list[Column]] = {}
    for i, name in enumerate(columns):
        for kind, holds in _cell_kinds(coerced, name, spec).items():
            bit = F.when(holds, F.lit(1 << i % WORD_BITS)).otherwise(F.lit(0)).cast("long")
            bits.setdefault(f"changed_{kind}_{i // WORD_BITS}", []).append(bit)
    # A few cells each in an array of its own projection: one expression over all cells of a mark is one method, which HotSpot leaves interpreted.
    parts: dict[str, list[Column]] = {m: [reduce(Column.bitwiseOR, found[j:j + CELLS]) for j in range(0, len(found), CELLS)] for m, found in bits.items()}
    flat = [(m, part) for m, own in parts.items() for part in own]
    placed = coerced.select(*columns, F.array(*[part for _, part in flat]).alias(PARTS))
    words = {m: reduce(Column.bitwiseOR, [F.col(PARTS)[k] for k, (own, _) in enumerate(flat) if own == m]) for m in parts}
    zero = F.lit(0).cast("long")
    return placed.select(*columns, *[words.get(m, zero).alias(m) for m in mark_names(columns)])


def drop_exact_marked(df: DataFrame, columns: Sequence[str], flag: str = "was_exact_duplicate") -> DataFrame:
    """Exact deduplication over ``columns``. A cell counts as changed if that of any copy was; RAW_ROWS counts the copies."""
    kept = df.groupBy(*columns).agg(*[F.bit_or(m).alias(m) for m in mark_names(columns)], F.count(F.lit(1)).alias(RAW_ROWS))
    return kept.withColumn(flag, F.col(RAW_ROWS) > 1)


def cleaning_audit(cleaned: DataFrame, columns: Sequence[str], spec: Spec) -> DataFrame:
    """Per raw column: role, rule and changed cells by kind among the kept rows; rows that each deduplication dropped.

    ``cleaned`` comes from ``clean(..., track=True)``, ``columns`` are those of the raw table in their order, also such that the
    plan has dropped since. One aggregate over the marks; an empty table gives zeros.
    """
    from assayer.operators.columns import ROLE_RULES, column_role
    from assayer.operators.profile import wide_to_rows

    def cells(i: int, kind: str) -> Column:
        return F.count_if(F.col(f"changed_{kind}_{i // WORD_BITS}").bitwiseAND(F.lit(1 << i % WORD_BITS)) != 0)

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    rows = wide_to_rows(
        cleaned,
        {c: {"fixed_role": F.lit(column_role(c, spec)).cast("string"), **{k: cells(i, k) for k in KINDS}} for i, c in enumerate(columns)},
        {"exact_copies_dropped": total(RAW_ROWS) - total(DISTINCT_ROWS), "logical_copies_dropped": total(DISTINCT_ROWS) - F.count(F.lit(1))},
    )
    changed = sum((F.col(k) for k in KINDS[1:]), F.col(KINDS[0]))
    role = F.coalesce("fixed_role", F.when(changed > 0, "transformed").otherwise("keep"))
    rules = F.create_map(*[F.lit(x) for pair in ROLE_RULES.items() for x in pair])
    return rows.select(
        "column", role.alias("role"), F.try_element_at(rules, role).alias("rule"), *KINDS, changed.alias("cells_changed"),
        "exact_copies_dropped", "logical_copies_dropped",
    )

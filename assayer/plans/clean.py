"""Cleaning plan.

normalise and coerce -> thresholds -> exact dedup -> derive -> logical dedup -> drop

Thresholds come from the rows before deduplication. Exact dedup groups by the
base columns in their final form (negatives gone, units canonical): every added
column is a function of them, so the grouping is the same and the shuffle is narrower.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions import numbers as N
from assayer.functions import text as X
from assayer.operators import audit as M
from assayer.operators import derive as D
from assayer.operators.dedup import drop_exact, drop_logical
from assayer.session import materialise
from assayer.spec import Spec


def non_ascii_columns(df: DataFrame, columns: list[str]) -> set[str]:
    """Text columns holding any non-ASCII character: one aggregate over the table."""
    if not columns:
        return set()
    row = df.agg(*[F.bool_or(~X.is_ascii(F.col(c))).alias(c) for c in columns]).first()
    return {c for c in columns if row[c]}


def coerce(df: DataFrame, spec: Spec, nfkc: str | bool = "auto") -> DataFrame:
    """Types and text forms: flattened url, dates, numbers, canonical text.

    ``nfkc``: ``"auto"`` looks once which text columns hold non-ASCII characters
    and sends only those through the Unicode function; ``True``/``False`` fix it.
    """
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != spec.url]
    textual = [c for c in strings if c not in spec.dates and c not in spec.numeric]
    wide = non_ascii_columns(df, textual) if nfkc == "auto" else (set(textual) if nfkc else set())
    canonical = {c for c in (*spec.text, spec.description, spec.multi_value, *spec.places) if c}

    def typed(name: str) -> Column | None:
        column = F.col(name)
        if name == spec.url:
            return X.flatten_url(df, name)
        if name in spec.dates:
            return N.to_timestamp(column)
        if name in spec.numeric:
            return N.to_number(column) if name in strings else N.finite(column)
        return X.normalize_text(column, name in wide) if name in strings else None

    def canonical_form(name: str) -> Column:
        text = X.canonicalize_text(F.col(name), name in spec.keep_not_applicable, nfkc=name in wide, normalized=True)
        return X.multivalue_text(text, normalized=True) if name == spec.multi_value else text

    # Two projections: the second reads each normalised text several times.
    first = {name: column for name in df.columns if (column := typed(name)) is not None}
    second = {name: canonical_form(name) for name in textual if name in canonical and name != spec.duration_unit}
    out = df.withColumns(first)
    return out.withColumns(second) if second else out


def _derive(df: DataFrame, spec: Spec, reference: DataFrame) -> DataFrame:
    out = df
    if spec.price:
        out = D.with_price_flags(out, spec, reference)
    if spec.duration and spec.duration_unit:
        out = D.with_duration(out, spec, reference, canonical=True)
    rules = D.temporal_rules(spec)
    return out.withColumns({
        **D.presence_flags(spec),
        "days_to_receipt": rules["days_to_receipt"],
        "effective_before_received": rules["effective_before_received"],
        "temporal_anomaly": rules["temporal_anomaly"],
        **D.competition_features(spec),
        **({"critical_completeness": D.completeness([c for c in spec.critical if c in out.columns])} if spec.critical else {}),
    })


def corrected(df: DataFrame, spec: Spec) -> DataFrame:
    """Of a coerced table: negative amounts to null and units to their canonical name, in place."""
    amounts = [c for c in (spec.price, spec.duration, *spec.counters) if c in df.columns]
    changes = {c: N.non_negative(F.col(c)) for c in amounts}
    if spec.duration_unit in df.columns:
        changes[spec.duration_unit] = X.duration_unit(F.col(spec.duration_unit), normalized=True)
    return df.withColumns(changes) if changes else df


def clean(df: DataFrame, spec: Spec, nfkc: str | bool = "auto", track: bool = False) -> DataFrame:
    """The cleaned table. ``track`` adds what ``operators.audit.cleaning_audit`` reads: marks of changed cells, and the raw and the
    distinct rows that each row stands for. Which rows are kept does not depend on it."""
    if track:
        return _tracked(df, spec, nfkc)
    base = materialise(corrected(coerce(df, spec, nfkc), spec))  # read by deduplication and, its few columns, by the thresholds
    derived = _derive(drop_exact(base), spec, base)
    candidates = [c for c in derived.columns if c not in spec.dropped and c != "was_exact_duplicate"]
    single = drop_logical(derived, spec.id, candidates, spec.latest, spec.tie_break)
    return single.drop(*[c for c in spec.dropped if c in single.columns])


def _tracked(df: DataFrame, spec: Spec, nfkc: str | bool) -> DataFrame:
    columns, marks = df.columns, M.mark_names(df.columns)
    coerced = coerce(df.withColumn(M.RAW, F.struct(*columns)), spec, nfkc)
    base = materialise(corrected(M.with_marks(coerced, columns, spec), spec))
    derived = _derive(M.drop_exact_marked(base, columns), spec, base)
    extra = [*marks, M.RAW_ROWS]
    candidates = [c for c in derived.columns if c not in (*spec.dropped, "was_exact_duplicate", *extra)]
    totals = {M.RAW_ROWS: F.sum(M.RAW_ROWS), M.DISTINCT_ROWS: F.count(F.lit(1))}
    single = drop_logical(derived, spec.id, candidates, spec.latest, spec.tie_break, carried=extra, totals=totals)
    return single.drop(*[c for c in spec.dropped if c in single.columns])

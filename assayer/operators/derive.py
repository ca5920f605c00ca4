"""Row-wise derivations of the cleaning stage, and the two thresholds they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import numbers as N
from assayer.functions import text as X
from assayer.operators.kernels import exact_quantiles, sized_side
from assayer.session import materialise
from assayer.spec import (
    DURATION_FLOOR_DAYS,
    DURATION_QUANTILE,
    NOT_APPLICABLE_LABEL,
    PRICE_MIN_GROUP,
    PRICE_QUANTILE,
    UNKNOWN_UNIT_LABEL,
    Spec,
)


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


# -- thresholds -------------------------------------------------------------


def group_thresholds(
    df: DataFrame, value: str, group: str, quantile: float = PRICE_QUANTILE, min_group: int = PRICE_MIN_GROUP
) -> DataFrame:
    """Upper quantile per group, for groups with at least ``min_group`` valid values."""
    valid = df.filter(F.col(value) >= 0)
    per_group = exact_quantiles(valid, [value], {"threshold": quantile}, keys=[group])
    return per_group.filter((F.col("n") >= min_group) & F.col(group).isNotNull()).select(group, "threshold")


def global_threshold(df: DataFrame, value: Column, quantile: float) -> DataFrame:
    """One row (none without valid values): the quantile of an expression over the whole table."""
    valid = df.select(value.alias("v")).filter(F.col("v") >= 0)
    return exact_quantiles(valid, ["v"], {"threshold": quantile}).select("threshold")


def with_price_flags(df: DataFrame, spec: Spec, reference: DataFrame | None = None) -> DataFrame:
    """Zero flag, log and extreme flag; price itself loses its negatives.

    ``reference`` is the table the thresholds come from (the rows before
    deduplication in the cleaning plan); by default the table itself.
    """
    price = spec.price
    needed = [c for c in (price, spec.price_group) if c]
    source = materialise(df.select(*needed)) if reference is None else reference  # read by four passes
    joined = df.withColumn(price, N.non_negative(F.col(price)))
    limit = global_threshold(source, F.col(price), PRICE_QUANTILE).scalar()
    if spec.price_group:
        groups = group_thresholds(source, price, spec.price_group).withColumnRenamed("threshold", "__limit")
        joined = joined.join(sized_side(groups), spec.price_group, "left")
        limit = F.coalesce(F.col("__limit"), limit)
    return joined.withColumns({
        "price_is_zero": F.coalesce(F.col(price) == 0, F.lit(False)),
        "price_log": N.log1p(F.col(price)),
        "flag_extreme_price": F.coalesce(F.col(price) > limit, F.lit(False)),
    }).select(*df.columns, "price_is_zero", "price_log", "flag_extreme_price")


def with_unit_token(df: DataFrame, spec: Spec) -> DataFrame:
    """The unit's token in projections of its own, as the expressions behind it read it several times."""
    return df.withColumn("__unit", X.normalize_text(F.col(spec.duration_unit))).withColumn("__unit", X.token_of(F.col("__unit")))


def duration_in_days(spec: Spec) -> Column:
    """Of a frame from ``with_unit_token``."""
    return N.non_negative(F.col(spec.duration)) * X.days_of_token(F.col("__unit"))


def with_duration(df: DataFrame, spec: Spec, reference: DataFrame | None = None, canonical: bool = False) -> DataFrame:
    """Duration in days, improbable flag, unknown-unit flag; the unit becomes its canonical name.

    ``canonical`` says that both tables hold canonical units and no negative durations already, so days are a look-up.
    """
    needed = dict.fromkeys((spec.duration, spec.duration_unit))
    source = materialise(df.select(*needed)) if reference is None else reference  # read by three passes
    if canonical:
        days = F.col(spec.duration) * X.days_of_unit(F.col(spec.duration_unit))
        limit = global_threshold(source, days, DURATION_QUANTILE).scalar()
        derived = df.withColumn("duration_days", days)
    else:
        limit = global_threshold(with_unit_token(source, spec), duration_in_days(spec), DURATION_QUANTILE).scalar()
        derived = with_unit_token(df, spec).withColumns({
            "duration_days": duration_in_days(spec),
            spec.duration_unit: X.unit_of_token(F.col("__unit")),
            spec.duration: N.non_negative(F.col(spec.duration)),
        }).drop("__unit")
    return derived.withColumns({
        "duration_improbable": F.coalesce(
            F.col("duration_days") > F.greatest(limit, F.lit(DURATION_FLOOR_DAYS)), F.lit(False)
        ),
        "unit_unknown": F.coalesce(F.col(spec.duration_unit) == UNKNOWN_UNIT_LABEL, F.lit(False)),
    })


def duration_not_computable(spec: Spec) -> Column:
    """Duration is null because the value or the unit is missing, unknown or not applicable."""
    return F.col("duration_days").isNull() & (
        F.col(spec.duration).isNull()
        | F.coalesce(F.col("unit_unknown"), F.lit(False))
        | F.coalesce(F.col(spec.duration_unit) == NOT_APPLICABLE_LABEL, F.lit(False))
    )


# -- expressions of one row -------------------------------------------------


def presence_flags(spec: Spec) -> dict[str, Column]:
    named = {
        "has_description": spec.description, "has_url": spec.url, "has_multi_value": spec.multi_value,
        "has_received": spec.received, "has_opened": spec.opened, "has_effective": spec.effective,
    }
    flags = {name: F.col(c).isNotNull() if c else F.lit(False) for name, c in named.items()}
    flags["place_missing"] = _any(*[F.col(c).isNull() for c in spec.places])
    flags["missing_dates"] = N.null_count(
        *[F.col(c) for c in (spec.published, spec.received, spec.opened, spec.effective) if c]
    )
    return flags


def temporal_rules(spec: Spec) -> dict[str, Column]:
    """Day-based order rules of the cleaning stage."""

    def days(start: str | None, end: str | None) -> Column:
        if not (start and end):
            return F.lit(None).cast("long")
        return N.whole_days(F.col(start), F.col(end))

    receipt = days(spec.published, spec.received)
    rules = {
        "received_before_published": receipt < 0,
        "opened_before_received": days(spec.received, spec.opened) < 0,
        "opened_before_published": days(spec.published, spec.opened) < 0,
        "effective_before_received": days(spec.received, spec.effective) < 0,
    }
    flags = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    return {"days_to_receipt": N.non_negative(receipt), **flags, "temporal_anomaly": _any(*rules.values())}


def timestamp_rules(spec: Spec) -> dict[str, Column]:
    """Order rules of the exploratory stage: compared as timestamps, including the last publication."""
    pairs = {
        "flag_received_before_published": (spec.received, spec.published),
        "flag_opened_before_received": (spec.opened, spec.received),
        "flag_effective_before_received": (spec.effective, spec.received),
        "flag_published_after_opened": (spec.opened, spec.published),
        "flag_published_after_effective": (spec.effective, spec.published),
        "flag_latest_before_published": (spec.latest, spec.published),
    }
    rules = {name: F.col(a) < F.col(b) for name, (a, b) in pairs.items() if a and b}
    flags = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    return {**flags, "temporal_anomaly": _any(*rules.values())}


def day_metrics(spec: Spec) -> dict[str, Column]:
    """Whole days from publication to receipt, opening and the first known end."""
    start = F.col(spec.published)
    ends = [F.col(c) for c in (spec.effective, spec.opened, spec.received) if c]
    return {
        "days_to_receipt": N.whole_days(start, F.col(spec.received)),
        "days_to_opening": N.whole_days(start, F.col(spec.opened)),
        "process_days": N.whole_days(start, F.coalesce(*ends)),
    }


def competition_features(spec: Spec) -> dict[str, Column]:
    total = F.lit(0.0)
    for name in spec.competition:
        total = total + F.greatest(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    ratio = F.lit(None).cast("double")
    if spec.suppliers and spec.ratio_denominator:
        ratio = N.guarded_ratio(F.col(spec.suppliers), F.col(spec.ratio_denominator))
    return {"competition_reported": total > 0, "competition_log": F.log1p(total), "supplier_ratio": ratio}


def completeness(columns: list[str]) -> Column:
    """Share of non-null values among the columns, four decimals."""
    present = N.present_count(*[F.col(c) for c in columns])
    return F.round(present / F.lit(float(len(columns))), 4)


def anomalous_rows(df: DataFrame, spec: Spec, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows breaking any order rule, with the fields needed to look into them."""
    rules = timestamp_rules(spec)
    shown = dict.fromkeys(
        c for c in (spec.id, spec.reference, *extra, spec.state, spec.published, spec.received, spec.opened, spec.effective) if c
    )
    return df.withColumns(rules).filter("temporal_anomaly").select(*shown, *[r for r in rules if r != "temporal_anomaly"])


def row_indicators(df: DataFrame, spec: Spec, key_columns: tuple[str, ...], state_columns: tuple[str, ...], undefined: str = "No Definido") -> DataFrame:
    """Quality indicators of one row; ``temporal_anomaly`` must already be present."""
    dates = [c for c in (spec.published, spec.received, spec.opened) if c]
    competition = F.lit(0.0)
    for name in spec.competition:
        competition = competition + F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    states = [F.col(c).isNotNull() & (F.col(c) != undefined) for c in state_columns]
    measured = [c for c in df.columns]
    return df.withColumns({
        "record_completeness": completeness(measured),
        "ind_url": F.col(spec.url).isNotNull() if spec.url else F.lit(False),
        "ind_description": F.col(spec.description).isNotNull() if spec.description else F.lit(False),
        "ind_price": F.coalesce(F.col(spec.price) > 0, F.lit(False)),
        "ind_keys": _all(*[F.col(c).isNotNull() for c in key_columns]),
        "ind_states": _all(*states) if states else F.lit(False),
        "ind_competition": competition > 0,
        "ind_temporal": _all(*[F.col(c).isNotNull() for c in dates]) & ~F.col("temporal_anomaly"),
    })


def winsorize(df: DataFrame, value: str, group: str, quantile: float) -> DataFrame:
    """Cap the upper tail of each group at its quantile."""
    caps = exact_quantiles(df, [value], {"__cap": quantile}, keys=[group]).select(group, "__cap")
    joined = df.join(sized_side(caps), group, "left")
    return joined.withColumn("was_capped", F.col(value) > F.col("__cap")).withColumn(
        value, F.when(F.col(value) > F.col("__cap"), F.col("__cap")).otherwise(F.col(value))
    ).drop("__cap")

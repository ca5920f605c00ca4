"""Engineered flags, weighted scores, labels and label confidence: one projection, no shuffle.

All functions take and return plain frames, so they apply to a batch or a
streaming table alike.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import numbers as N
from assayer.functions import text as X
from assayer.spec import (
    COMPETITION_SATURATION,
    COMPETITION_WEIGHTS,
    COMPLETENESS_WEIGHTS,
    DUPLICATE_PENALTY,
    HIGH_RISK_THRESHOLD,
    MIN_DESCRIPTION_LENGTH,
    MIN_REFERENCE_LENGTH,
    OPENING_WINDOW_DAYS,
    RECEIPT_WINDOW_DAYS,
    RISK_THRESHOLD,
    TEMPORAL_WEIGHTS,
    TOTAL_WEIGHTS,
    TRACEABILITY_WEIGHTS,
    Spec,
)


def _col(name: str | None) -> Column:
    return F.col(name) if name else F.lit(None).cast("string")


def _number(name: str | None) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name else F.lit(0.0)


def _all_present(names: tuple[str | None, ...]) -> Column:
    return reduce(lambda a, b: a & b, [X.non_placeholder(_col(n)) for n in names])


def _any_not_null(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in names], F.lit(False))


def _total(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [_number(n) for n in names], F.lit(0.0))


def engineer_flags(df: DataFrame, spec: Spec) -> DataFrame:
    description = _col(spec.description)
    length = X.text_length(description)
    duplicate = reduce(
        lambda a, b: a | b,
        [F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in ("was_exact_duplicate", "was_logical_duplicate") if c in df.columns],
        F.lit(False),
    )
    published, received, opened = F.col(spec.published), F.col(spec.received), F.col(spec.opened)
    anomaly = F.coalesce(F.col("temporal_anomaly").cast("boolean"), F.lit(False)) if "temporal_anomaly" in df.columns else F.lit(False)

    basic = df.withColumns({
        "description_length": length,
        "flag_useful_description": N.flag(X.non_placeholder(description) & (length >= MIN_DESCRIPTION_LENGTH)),
        "flag_has_category": N.flag(X.non_placeholder(_col(spec.category))),
        "flag_has_price": N.flag(F.col(spec.price) > 0),
        "flag_has_place": N.flag(_all_present(spec.places)),
        "flag_has_type_and_mode": N.flag(_all_present((spec.mode, spec.type))),
        "flag_valid_id": N.flag(X.matches(_col(spec.id), spec.id_pattern)),
        "flag_valid_reference": N.flag(
            X.non_placeholder(_col(spec.reference)) & (X.text_length(_col(spec.reference)) >= MIN_REFERENCE_LENGTH)
        ),
        "flag_public_url": N.flag(X.matches(_col(spec.url), spec.url_pattern)),
        "flag_has_portfolio": N.flag(X.non_placeholder(_col(spec.portfolio))),
        "duplicate_penalty": N.flag(duplicate),
        "days_published_received": N.fractional_days(published, received),
        "days_received_opened": N.fractional_days(received, opened),
        "days_published_opened": N.fractional_days(published, opened),
        "flag_dates_available": N.flag(published.isNotNull() & received.isNotNull() & opened.isNotNull()),
        "total_responses": _total(spec.responses),
        "total_interest": _total(tuple(c for c in (*spec.invited, spec.suppliers) if c)),
        "flag_competition_data": N.flag(_any_not_null(spec.competition)),
        "flag_minimal_competition": N.flag((_number(spec.suppliers) >= 2) | (_number(spec.direct_responses) >= 2)),
        "__anomaly": anomaly,
    })
    receipt, opening = F.col("days_published_received"), F.col("days_received_opened")
    flagged = basic.withColumns({
        "missing_required_fields": F.lit(len(COMPLETENESS_WEIGHTS)) - reduce(lambda a, b: a + b, [F.col(c) for c in COMPLETENESS_WEIGHTS]),
        "flag_published_before_received": N.flag(receipt >= 0),
        "flag_received_before_opened": N.flag(opening >= 0),
        "flag_receipt_window_ok": N.flag(receipt.between(0, RECEIPT_WINDOW_DAYS)),
        "flag_opening_window_ok": N.flag(opening.between(0, OPENING_WINDOW_DAYS)),
        "flag_participation": N.flag((F.col("total_responses") > 0) | (F.col("total_interest") > 0)),
        "competition_intensity": N.clip(
            F.log1p(F.col("total_responses") + _number(spec.suppliers)) / F.lit(math.log1p(COMPETITION_SATURATION))
        ),
    })
    coherent = reduce(lambda a, b: a & b, [F.col(c) == 1 for c in TEMPORAL_WEIGHTS]) & ~F.col("__anomaly")
    return flagged.withColumn("flag_temporal_coherence", N.flag(coherent)).drop("__anomaly")


def add_scores(df: DataFrame) -> DataFrame:
    parts = df.withColumns({
        "score_completeness": N.weighted_sum(COMPLETENESS_WEIGHTS),
        "score_traceability_base": N.weighted_sum(TRACEABILITY_WEIGHTS),
        "score_temporal": N.weighted_sum(TEMPORAL_WEIGHTS),
        "score_competition": N.weighted_sum(COMPETITION_WEIGHTS),
    })
    penalised = parts.withColumn(
        "score_traceability",
        N.clip(F.col("score_traceability_base") - F.col("duplicate_penalty").cast("double") * F.lit(DUPLICATE_PENALTY)),
    )
    return penalised.withColumn("quality_score", N.weighted_sum(TOTAL_WEIGHTS))


def add_labels(df: DataFrame, spec: Spec) -> DataFrame:
    score = F.col("quality_score")
    dated = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (spec.published, spec.received, spec.opened)])
    evidence = [X.non_placeholder(_col(c)) for c in (spec.id, spec.reference, spec.url, spec.portfolio)]

    def tally(conditions: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [N.flag(c) for c in conditions])

    labelled = df.withColumns({
        "low_quality_risk": N.flag(score < RISK_THRESHOLD),
        "risk_level": F.when(score < HIGH_RISK_THRESHOLD, "alto").when(score < RISK_THRESHOLD, "medio").otherwise("bajo"),
        "evidence_completeness": F.lit(1),
        "evidence_traceability": N.flag(tally(evidence) >= 3),
        "evidence_temporal": N.flag(dated),
        "evidence_competition": N.flag(_any_not_null(spec.competition)),
    })
    measured = labelled.withColumns({
        "evidence_coverage": (
            F.col("evidence_completeness") + F.col("evidence_traceability")
            + F.col("evidence_temporal") + F.col("evidence_competition")
        ) / F.lit(4.0),
        "margin_to_threshold": F.abs(score - F.lit(RISK_THRESHOLD)),
    })
    coverage, margin = F.col("evidence_coverage"), F.col("margin_to_threshold")
    return measured.withColumn(
        "label_confidence",
        F.when((coverage >= 0.75) & (margin >= 0.15), "alta")
        .when((coverage >= 0.50) & (margin >= 0.07), "media")
        .otherwise("baja"),
    )

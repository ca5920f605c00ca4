"""Scoring plan: contract, flags, scores, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame

from assayer.operators.score import add_labels, add_scores, engineer_flags
from assayer.sources.scan import enforce_contract
from assayer.spec import Spec


def score(df: DataFrame, spec: Spec) -> DataFrame:
    """One lazy projection over the cleaned table."""
    contracted = enforce_contract(
        df,
        required=spec.required(),
        dates=[c for c in (spec.published, spec.received, spec.opened) if c],
        numbers=[c for c in (spec.price, *spec.competition) if c],
        flags=["temporal_anomaly", "was_exact_duplicate", "was_logical_duplicate"],
    )
    return add_labels(add_scores(engineer_flags(contracted, spec)), spec)

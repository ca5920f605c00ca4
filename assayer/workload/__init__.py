"""Registered queries: one entry per operator, each with its check SQL where SQL can say it."""

from assayer.workload.registry import ORACLES, QUERIES, complete
from assayer.workload import (  # noqa: F401  (importing registers)
    q_columns,
    q_inference,
    q_models,
    q_profiles,
    q_rows,
    q_sources,
)

complete()

__all__ = ["ORACLES", "QUERIES"]

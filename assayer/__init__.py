"""Assayer: data quality, scoring and statistical inference over wide tables, as Spark jobs.

Sub-packages

* ``sources``    reading, windowed extraction, sinks
* ``functions``  column expressions (text, numbers, dates) and scalar tail probabilities
* ``operators``  one module per family: column audit, profiles, dedup, scores, tests, models
* ``plans``      the whole pipelines: clean, score, describe, infer, report
* ``streaming``  the stateless scoring plan over a streaming frame
* ``workload``   the fixtures and the registered queries with their check SQL
"""

from assayer.session import configure, session
from assayer.spec import Spec, procurement_spec

__all__ = ["Spec", "configure", "procurement_spec", "session"]

"""The scoring plan over a streaming table.

Scoring is a stateless projection, so a stream needs no watermark or state: the
batch plan is applied to the streaming frame as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from assayer.plans.score import score
from assayer.session import configure
from assayer.spec import Spec


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return configure(spark).readStream.schema(schema).parquet(path)


def score_stream(stream: DataFrame, spec: Spec, path: str, checkpoint: str) -> StreamingQuery:
    """Score each arriving file once and append it to ``path``; ends when the input is used up."""
    return (
        score(stream, spec).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

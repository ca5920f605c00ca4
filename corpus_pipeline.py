"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes each stage's rows as Parquet to the shared folder and
gives the next stage what it reads there, so a lost executor costs no finished stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayer.llm.common import read_table, written
from assayer.llm.decontaminate import uncontaminated
from assayer.llm.frames import token_files
from assayer.llm.mixing import mixed_documents
from assayer.llm.quality import kept_documents
from assayer.llm.similar import one_of_similar
from assayer.session import configure

VOCABULARY = "byte_bpe_50k.json"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _configured(stage: Stage) -> Stage:
    """The stage under the settings of ``configure``, also where it is called by itself."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)

    return run_stage


@_configured
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return kept_documents(docs)


@_configured
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: the one with the smallest doc_id."""
    return one_of_similar(docs)


@_configured
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


@_configured
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


@_configured
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: (doc_id, start, n_tokens, ids_crc32)."""
    return token_files(docs, public_tokenizers.path(VOCABULARY), spark)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing), ("token files", tokens),
]
ORACLE_SQL = None  # SQL has no XXH64 bits by shingle and no vocabulary; the tests hold run() against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs

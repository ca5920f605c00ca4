"""Registered queries of the corpus operators, with their check SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import read_table, scratch_path
from assayer.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        key = function.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(configure(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


@query()
def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query()
def op2_mix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.secrets import find_secrets

    return find_secrets(read_table(spark, sf_dir, "documents"))


@query()
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.suffixes import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


@query()
def op5_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.quality import repetition_quality

    return repetition_quality(read_table(spark, sf_dir, "documents"))


@query()
def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.decontaminate import contamination

    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query()
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.tokens import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query()
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.html import extract

    return extract(read_table(spark, sf_dir, "pages"))


@query()
def op10_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.frames import read_token_files, write_token_files

    files = write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), scratch_path(spark, "tokens"))
    return read_token_files(files)


@query()
def op11_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.toxicity import fit

    docs = read_table(spark, sf_dir, "documents")
    return fit(docs, read_table(spark, sf_dir, "labels")).score(docs)


@query()
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.conversations import repair_conversations

    return repair_conversations(read_table(spark, sf_dir, "conversations"))


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assayer.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, sf_dir, "documents"))

"""A training corpus from documents: five stages, each an operator of annulus.llm on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annulus.llm import langid, near_copies, packing, secret_scan, substring_dedup
from annulus.llm.common import Scratch, table
from annulus.llm.queries import tokenizer_file, word_pattern

#: SQL can't express compression, rolling hashes or packing; tests hold near copies, secrets and packing against brute force,
#: passages against bounds from it, language ID against held-out labels.
#: All stages give empty results for empty tables and leave other columns of docs as they were, whatever their names.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin; null texts and texts without a letter go, repeated rows stay."""
    return langid.keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five-word shingles, similarity 0.8; repeated rows count as copies."""
    return near_copies.drop_near_copies(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; one of which nothing is left goes, null texts stay."""
    cut = substring_dedup.substring_dedup(docs)
    return cut.where("text is null or text <> ''")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets masked; null texts stay."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their place in a sequence, repeated rows each for themselves."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), word_pattern(), with_ids=True, added=True)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("secrets", secrets), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written as Parquet in the shared folder and read by the next."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs

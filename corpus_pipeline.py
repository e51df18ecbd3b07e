"""From raw documents to token ids: quality rules, line and near-duplicate removal, mix, encoding."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import byte_bpe, line_dedup, mixing, near_dedup, quality_rules
from llm.common import store, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The near-duplicate stage: words of a shingle, and the least similarity in percent.
SHINGLE_WORDS = 5
PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars follows the text."""
    kept = line_dedup.drop_shared_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.drop_near_duplicates(docs, SHINGLE_WORDS, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's share asks for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and token ids of each document taken."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs, path, public_tokenizers.PATTERN, carry=("lang", "source"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mixing", mix),
    ("byte_bpe", tokens),
]

#: The mix draws by hashes that SQL cannot compute, so the stages are tested by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what a stage returns is stored for the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

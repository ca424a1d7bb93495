"""A corpus pipeline in five stages, each applying one operator to all that the stage before kept.

Quality rules drop documents, near-dedup leaves one document of each group, personal data is masked in the texts, the mix
repeats and drops documents to meet target weights, and the last stage encodes what is left. All but the last return the
columns of documents. Null and empty texts, ties, repeated rows and empty tables are handled as the operators say.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codexspark.llm import mixing, near_dedup, pieces, pii, quality_rules
from codexspark.llm.queries import tokenizer_file
from codexspark.llm.shared import prepare, staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the table's compression bands and the base rule keep."""
    return quality_rules.filter_quality(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return near_dedup.deduplicated(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with spans of personal data replaced by their kind; n_chars follows."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) for each row."""
    return pieces.encoded(docs, tokenizer_file("piece_bpe_32k.model"))


def bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with Arrow batches bounded by rows and bytes, whoever calls it and in whatever session."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(prepare(spark), docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", bounded(keep_quality)),
    ("near_dedup", bounded(drop_near_duplicates)),
    ("pii", bounded(mask_personal_data)),
    ("mixing", bounded(mix_sources)),
    ("pieces", bounded(encode_pieces)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Compression ratios, scored spans and piece ids can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None

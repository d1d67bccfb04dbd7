"""A training-data pipeline over ``documents`` made of the operators in ``lexmill.llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept; every stage
but the last returns the columns of its input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from lexmill.llm.queries import TOKENIZER
from lexmill.session import new_folder, stored

# Shares of tokens after cleaning; the rules before have left few poor documents.
TARGETS = {"clean": 0.97, "poor": 0.01, "toxic": 0.018, "poor_toxic": 0.002}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that a rule rejects go."""
    return quality_rules.kept_rows(docs)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each text stays."""
    index = exact_dedup.open_index(spark, new_folder(spark, "digest-index"), docs.count())
    return exact_dedup.kept_rows(index, docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join on five-word shingles at 0.8: one document of each group stays."""
    return ngram_join.kept_rows(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document comes as often as its fitted rate says."""
    mix, _ = mixing.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), targets=TARGETS)
    return mixing.mixed_rows(docs, mix)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences: the pieces, with the checksum of their ids."""
    return packing.report(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", clean),
    ("exact dedup", distinct_texts),
    ("n-gram join", one_of_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

# Mixing weights and near-duplicate groups come from iterations that SQL does not express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), new_folder(spark, name.replace(" ", "-")))
    return docs

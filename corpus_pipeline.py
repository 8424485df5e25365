"""The corpus pipeline: five stages over the documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from labelscope.llm import exact, language, minhash, mixing, packing
from labelscope.llm.queries import tokenizer
from labelscope.llm.tables import documents
from labelscope.sources import materialize, temporary_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which one learned language has at least half."""
    return language.kept_languages(docs, least_share=0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, one with the smallest id."""
    return exact.drop_copies(docs, one_row=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: five words, 80 %."""
    return minhash.drop_near_duplicates(docs, shingle=5, percent=80, one_row=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 2,048 tokens."""
    return packing.packed(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No SQL expresses the language, near-duplicate and packing stages; the tests
#: hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again.

    What a stage has stored on its way is removed when its rows are written.
    """
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, temporary=False)
    return docs

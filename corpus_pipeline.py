"""The corpus pipeline: rules, exact and near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import exact_dedup, near_dedup, packing, quality_rules, suffix_dedup
from palisade.session import materialise
from palisade.sources.tables import read_table

#: Passages of fifty words, even of short ones, are at least this long.
PASSAGE = suffix_dedup.Window(length=200, span=128)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_rules.filter_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without strings of ``PASSAGE`` that also occur elsewhere; a text may end up empty."""
    return suffix_dedup.drop_repeats(docs, PASSAGE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, public_tokenizers.PATTERN, end_id=2, capacity=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("suffix_dedup", passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


#: Fingerprints, repeated strings and packing can't be put in SQL; tests hold the rows against brute force.
ORACLE_SQL = None

"""Labelled text for training and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import fixed_values as fv


def seed_samples(spark: SparkSession) -> DataFrame:
    """The built-in samples: label 1 adversarial, 0 benign."""

    def texts(values: list[str]) -> DataFrame:
        array = F.array(*[F.lit(v) for v in values])
        return spark.range(0, 1, 1, 1).select(F.explode(array).alias("text"))

    return labelled_union(texts(fv.ADVERSARIAL_SEEDS), texts(fv.BENIGN_SEEDS)).coalesce(1)


def labelled_union(adversarial: DataFrame, benign: DataFrame) -> DataFrame:
    return adversarial.select("text", F.lit(1).alias("label")).unionByName(
        benign.select("text", F.lit(0).alias("label"))
    )


def labelled_documents(
    documents: DataFrame, labels: DataFrame, label_col: str = "toxic", key: str = "doc_id"
) -> DataFrame:
    """Documents that carry a label.  The optimizer picks the join by size."""
    return documents.join(labels.select(key, F.col(label_col).alias("label")), key).filter(
        F.col("label").isNotNull()
    )


def corpus_or_seeds(spark: SparkSession, samples: DataFrame | None) -> DataFrame:
    """The given samples, or the seeds when there are none."""
    if samples is None or samples.isEmpty():
        return seed_samples(spark)
    return samples


def sides_or_seeds(
    spark: SparkSession, adversarial: DataFrame | None, benign: DataFrame | None
) -> DataFrame:
    """Labelled samples of two tables of ``text``; an absent or empty one is replaced by its seeds."""
    seeds = seed_samples(spark)

    def side(given: DataFrame | None, label: int) -> DataFrame:
        return seeds.filter(F.col("label") == label) if given is None or given.isEmpty() else given

    return labelled_union(side(adversarial, 1), side(benign, 0))

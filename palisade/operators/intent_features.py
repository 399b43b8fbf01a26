"""Gram counts, document frequencies, IDF and class weights."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.gram_encoder import gram_counts, gram_document_counts
from palisade.session import ship_package


def lowered(text_col: str) -> Column:
    return F.lower(F.make_valid_utf8(F.col(text_col)))


def term_frequencies(df: DataFrame, keys: list[str], text_col: str = "text", known=None) -> DataFrame:
    """(keys, gram, tf), counted inside each row and so without a shuffle.

    The keys must identify a row.  ``known``, a broadcast :class:`GramFilter`, leaves
    out grams that aren't in its set, so that they aren't shuffled to a join.
    """
    ship_package(df.sparkSession)
    texts = df.filter(F.col(text_col).isNotNull()).select(
        *keys, lowered(text_col).alias("__text")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = known.value.might_contain if known is not None else None
            for row, gram, tf in gram_counts(batch["__text"].tolist(), keep):
                counts = batch[keys].iloc[row].reset_index(drop=True)
                yield counts.assign(gram=gram, tf=tf)

    schema = T.StructType(
        [texts.schema[k] for k in keys]
        + [T.StructField("gram", T.StringType()), T.StructField("tf", T.LongType())]
    )
    return texts.mapInPandas(count, schema)


def document_frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(gram, df).

    A text is reduced to its set of grams inside its own row and the sets are
    added up per batch, so that no shuffle is keyed by document and only partial
    counts per gram move.
    """
    ship_package(df.sparkSession)
    texts = df.filter(F.col(text_col).isNotNull()).select(lowered(text_col).alias("__text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for grams, n in gram_document_counts(batch["__text"].tolist()):
                if grams:  # texts of white space only have none
                    yield pd.DataFrame({"gram": grams, "df": n})

    partial = texts.mapInPandas(count, "gram string, df long")
    return partial.groupBy("gram").agg(F.sum("df").alias("df"))


def gram_idf(df: DataFrame, text_col: str = "text", n: int | None = None) -> DataFrame:
    """(gram, df, idf) with idf = ln((1 + n) / (1 + df)) + 1 over n texts.

    ``n`` is counted unless given.
    """
    total = df.agg(F.count(F.col(text_col))).scalar() if n is None else F.lit(n)
    return with_idf(document_frequencies(df, text_col), total)


def with_idf(frequencies: DataFrame, total: Column) -> DataFrame:
    """Document frequencies with the idf over ``total`` texts."""
    return frequencies.withColumn("idf", F.log((total + 1) / (F.col("df") + 1)) + 1)


def join_grams(terms: DataFrame, table: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Join gram counts to a table with one row per gram.

    Common grams occur in nearly every text.  The table is repeated ``salts``
    times and each text uses one copy, so that no gram's rows all meet in one
    task.  Grams that are not in the table are dropped.
    """
    salted = terms.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    copies = table.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>"))
    )
    return salted.join(copies, ["gram", "__salt"]).drop("__salt")


def class_weights(samples: DataFrame, label_col: str = "label") -> DataFrame:
    """(label, n, weight) with weight = total / (classes * n).

    The window runs over the counts, one row per class.
    """
    counts = samples.groupBy(label_col).agg(F.count("*").alias("n"))
    all_classes = Window.partitionBy(F.lit(0))
    total, classes = F.sum("n").over(all_classes), F.count("*").over(all_classes)
    return counts.select(label_col, "n", (total / (classes * F.col("n"))).alias("weight"))

"""Scoring texts with a fitted intent model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions.once import compute_once
from palisade.functions.text import as_column
from palisade.operators.intent_features import join_grams, term_frequencies
from palisade.operators.intent_model import IntentModel
from palisade.session import materialise


def score_column(text: Column, model: IntentModel) -> Column:
    """Adversarial probability of each text, for models small enough to send.

    Stateless and without a shuffle, so it also serves streams.  Null text gives
    null.
    """
    shared, intercept = model.broadcast, model.intercept
    if shared is None:
        raise ValueError("a model in join form has no column; use score()")

    @F.pandas_udf("double")
    def adversarial_score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = shared.value
        for lowered in batches:
            known = lowered.notna().to_numpy()
            scores = np.full(len(lowered), np.nan)
            scores[known] = 1.0 / (1.0 + np.exp(-(encoder.dot(lowered[known].tolist()) + intercept)))
            yield pd.Series(scores)

    return adversarial_score(F.lower(F.make_valid_utf8(text)))


def score_by_join(
    df: DataFrame, model: IntentModel, keys: list[str], text_col: str = "text", salts: int = 16
) -> DataFrame:
    """(keys, score) by joining gram counts to the model table, for any model size.

    Texts with no known gram get sigmoid(intercept).  Most unknown grams are left
    out by a filter before the shuffle, and the rest by the join.
    """
    known = df.filter(F.col(text_col).isNotNull())
    terms = join_grams(term_frequencies(known, keys, text_col, model.known), model.grams, keys, salts)
    value = (F.log("tf") + 1) * F.col("idf")
    sums = (
        terms.select(*keys, value.alias("x"), (value * F.col("weight")).alias("xw"))
        .groupBy(*keys)
        .agg((F.sum("xw") / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("dot"))
    )
    logit = F.coalesce("dot", F.lit(0.0)) + F.lit(model.intercept)
    return (
        known.select(*keys)
        .join(sums, keys, "left")
        .select(*keys, (1 / (1 + F.exp(-logit))).alias("score"))
    )


def intent(score: Column, threshold: float | Column = fv.DEFAULT_THRESHOLD) -> Column:
    """Struct of label, confidence and adversarial_score; null where the score is."""
    adversarial = score >= as_column(threshold)
    return F.when(
        score.isNotNull(),
        F.struct(
            F.when(adversarial, "adversarial").otherwise("benign").alias("label"),
            F.when(adversarial, score).otherwise(1 - score).alias("confidence"),
            score.alias("adversarial_score"),
        ),
    )


def score(
    df: DataFrame,
    model: IntentModel,
    text: str | Column = "text",
    keys: list[str] | None = None,
    into: str = "score",
) -> DataFrame:
    """Add the adversarial probability of ``text``.

    A model in array form is applied in place.  In join form its table is joined
    to the grams of each text: per row where ``keys`` identify the rows, and else
    per distinct text, which needs no key, scores repeated texts once, and takes
    null keys and repeated rows as they come.
    """
    text = F.col(text) if isinstance(text, str) else text
    if model.broadcast is not None:
        return compute_once(df, {into: score_column(text, model)})
    if df.isStreaming:
        raise ValueError("a model in join form scores a stream batch by batch: see start_batches")
    if keys:
        scores = score_by_join(df.select(*keys, text.alias("__text")), model, keys, "__text")
        return df.join(scores.withColumnRenamed("score", into), keys, "left")
    # Written once, since the rows are needed for their texts and for their scores.
    staged = materialise(df.select("*", text.alias("__scored"), F.sha2(text, 256).alias("__digest")), "to_score")
    texts = staged.filter("__scored IS NOT NULL").select("__digest", "__scored").dropDuplicates(["__digest"])
    scores = score_by_join(texts, model, ["__digest"], "__scored").withColumnRenamed("score", into)
    return staged.drop("__scored").join(scores, "__digest", "left").drop("__digest")

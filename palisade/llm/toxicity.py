"""Toxicity by weak supervision.

1. *Voters.*  Lexicon voters are words, pattern voters are word beginnings
   (``^lowe\\w*``); both are mined from labelled training rows, from what occurs
   in toxic texts and hardly in others.  A voter fires or it doesn't.
2. *Label model.*  A generative model of the votes, fitted by EM without labels:
   how often each voter fires on toxic and on other texts, and how common
   toxicity is.  Voters that fire together more than the labels explain are
   correlated; each counts for its share of the group of voters that it repeats.
3. *Classifier.*  Logistic regression over words and word beginnings, trained on
   the label model's posterior probabilities, so that it also learns words that
   no voter knows.

Scoring is a lookup of a text's words in the classifier's weights, one row at a
time and without a shuffle.  The model is fitted on at most ``SAMPLE_ROWS``
labelled rows (the ones whose ids hash lowest) and has at most ``FEATURES``
weights; both bound what the driver holds and what is sent to executors.

Labels, language, source and id are never inputs of a score.  Null and empty
texts get the classifier's intercept.  Without a toxic training row every score
is 0.  Rows map to rows, repeated and null ids included; a null id is never
held out, and has no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ship, text_of
from palisade.session import materialise

SAMPLE_ROWS = 20_000
FEATURES = 5_000
VOTERS = 400
#: A voter's firings are toxic at least this often, by a cautious estimate.
VOTER_PRECISION = 0.85
MIN_TEXTS = 4
BEGINNINGS = (4, 5, 6, 7)
FOLDS = 5
_WORD = re.compile(r"\w+")
#: Characters of a text that are looked at together; a word is never cut.
_PIECE = 1 << 20


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def features(text: str) -> set[str]:
    """The words of a text, and their beginnings marked with a caret."""
    words: set[str] = set()
    at = 0
    while at < len(text):
        stop = at + _PIECE
        while stop < len(text) and not text[stop].isspace():
            stop += 1
        words.update(_WORD.findall(text[at:stop].lower()))
        at = stop
    out = set(words)
    for n in BEGINNINGS:
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


@dataclass
class ToxicityModel:
    intercept: float
    weights: dict[str, float] = field(default_factory=dict)
    voters: list[str] = field(default_factory=list)

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        z = self.intercept + sum(map(self.weights.__getitem__, features(text) & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def label_model(fires: np.ndarray, prior: float, precision: float = VOTER_PRECISION, rounds: int = 50) -> np.ndarray:
    """Posterior probabilities of toxicity given rows of votes, by EM.

    A voter that doesn't fire abstains; only texts on which all abstain are
    judged by the silence.  ``prior`` starts the share of toxic texts.  Voters are
    known to be right at least ``precision`` of the time, which bounds how often
    they may fire on other texts.
    """
    n, k = fires.shape
    votes = fires.astype(np.float64)
    voted = fires.any(axis=1)
    posterior = np.where(voted, precision, prior / 10)
    share = np.ones(k)
    for step in range(rounds):
        prior = float(np.clip(posterior.mean(), 1e-3, 0.5))
        on_toxic = np.clip((posterior @ votes + 0.1) / (posterior.sum() + 1), 1e-4, 0.999)
        on_other = np.clip(((1 - posterior) @ votes + 0.01) / ((1 - posterior).sum() + 1), 1e-6, 0.5)
        on_other = np.minimum(on_other, on_toxic * prior / (1 - prior) * (1 - precision) / precision)
        if step == 5:
            # Correlation that is left once the label is known.
            centred = votes - posterior[:, None] * on_toxic - (1 - posterior[:, None]) * on_other
            scale = np.sqrt((centred**2).mean(axis=0)) + 1e-9
            repeats = np.abs(centred.T @ centred) / n / np.outer(scale, scale)
            share = 1 / np.maximum(1, np.where(repeats > 0.7, repeats, 0).sum(axis=0))
        odds = np.log(prior / (1 - prior))
        said = odds + votes @ (np.log(on_toxic / on_other) * share)
        silent = odds + (np.log((1 - on_toxic) / (1 - on_other)) * share).sum()
        z = np.where(voted, said, silent)
        new = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        done = step > 5 and np.abs(new - posterior).max() < 1e-6
        posterior = new
        if done:
            break
    return posterior


def logistic(rows: list[np.ndarray], target: np.ndarray, width: int, l2: float = 1e-4, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression on binary features and soft labels (Adam, full batch)."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    on = np.concatenate(rows) if rows else np.empty(0, np.int64)
    w, b = np.zeros(width), float(np.log(max(target.mean(), 1e-6) / max(1 - target.mean(), 1e-6)))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(at, w[on], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        gradient = np.bincount(on, error[at], width) / len(rows) + l2 * w
        gradient_b = error.mean()
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        mb, vb = 0.9 * mb + 0.1 * gradient_b, 0.999 * vb + 0.001 * gradient_b**2
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on the labelled rows that are not held out."""
    ship(docs)
    labelled = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id is not null and toxic is not null")
        .filter(~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(SAMPLE_ROWS)
    )
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    # At most SAMPLE_ROWS pairs of numbers: small enough to send everywhere.
    sample = texts.join(F.broadcast(labelled), "doc_id").select("toxic", text_of().alias("text"))

    @F.pandas_udf("array<string>")
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([sorted(features(t)) for t in rows], dtype=object)

    sample = materialise(sample.select("toxic", words("text").alias("features")), "sample")
    totals = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, n_toxic = totals[0], totals[1] or 0
    if not n_toxic or n_toxic == n:
        return ToxicityModel(0.0)
    counts = sample.select("toxic", F.explode("features").alias("f")).groupBy("f")
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).filter(F.col("n") >= MIN_TEXTS)
    # How far the toxic share among texts with the feature lies from the overall one, in deviations.
    base = n_toxic / n
    counts = counts.withColumn("z", (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base)))
    chosen = counts.orderBy(F.abs("z").desc(), "f").limit(FEATURES).toPandas()
    if chosen.empty:
        return ToxicityModel(0.0)
    precise = chosen[(chosen["t"] + 0.5) / (chosen["n"] + 1) >= VOTER_PRECISION]
    voters = precise.sort_values(["z", "f"], ascending=[False, True])["f"].head(VOTERS).tolist()
    if not voters:
        return ToxicityModel(0.0)
    place = {f: i for i, f in enumerate(chosen["f"])}

    @F.pandas_udf("array<int>")
    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([np.array([place[f] for f in r if f in place], np.int32) for r in rows], dtype=object)

    rows = [np.asarray(r, np.int64) for r in sample.select(placed("features").alias("f")).toPandas()["f"]]
    column = np.full(len(place), -1)
    column[[place[v] for v in voters]] = np.arange(len(voters))
    fires = np.zeros((len(rows), len(voters)), bool)
    for i, r in enumerate(rows):
        own = column[r]
        fires[i, own[own >= 0]] = True
    posterior = label_model(fires, min(base, 0.5))
    weights, intercept = logistic(rows, posterior, len(place))
    kept = np.abs(weights) > 1e-3
    return ToxicityModel(intercept, {f: float(weights[i]) for f, i in place.items() if kept[i]}, voters)


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    ship(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sent.value.score(t) for t in texts], dtype="float64")

    scored = docs.select("doc_id", held_out().alias("held_out"), score(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

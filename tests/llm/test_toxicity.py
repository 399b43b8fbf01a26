"""Held-out accuracy, the label model on known votes, and odd rows."""

import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")]


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    out = queries.QUERIES["op9_toxicity"](spark, FOLDER).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()
    assert [zlib.crc32(str(d).encode()) % 5 == 0 for d in out["doc_id"]] == out["held_out"].tolist()
    held = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    toxic, clean = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert (toxic["predicted"] == 1).mean() > 0.85  # a few labelled texts hold no toxic word at all
    assert (clean["predicted"] == 0).mean() > 0.99


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(5_000) < 0.1
    good = [np.where(truth, rng.random(5_000) < 0.5, rng.random(5_000) < 0.001) for _ in range(8)]  # within the precision that voters are known to have
    copies = [good[0]] * 4  # one voter under five names must not outvote the others
    posterior = toxicity.label_model(np.array(good + copies).T, 0.1)
    assert ((posterior > 0.5) == truth).mean() > 0.98


def test_scores_do_not_read_labels_language_or_source(spark, tables):
    docs, labels = tables
    model = toxicity.ToxicityModel(-1.0, {"idiot": 5.0, "^lowe": 4.0}, ["idiot"])
    few = docs.limit(50)
    plain = toxicity.score_documents(few, model).select("doc_id", "score")
    other = toxicity.score_documents(few.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), model).select("doc_id", "score")
    assert sorted(plain.collect()) == sorted(other.collect())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "idiot"), (3, "IDIOT!"), (3, "IDIOT!"), (4, "loweiisch " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    model = toxicity.ToxicityModel(-1.0, {"idiot": 5.0, "^lowe": 4.0}, ["idiot"])
    out = toxicity.score_documents(docs, model).toPandas()
    assert out["predicted"].tolist() == [0, 0, 1, 1, 1, 1]
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none).score("anything") == 0.0
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_beginnings():
    assert toxicity.features("Loweiisch x") == {"loweiisch", "x", "^lowe", "^lowei", "^loweii", "^loweiis"}
    assert isinstance(pd.Series(sorted(toxicity.features("")), dtype=object), pd.Series)

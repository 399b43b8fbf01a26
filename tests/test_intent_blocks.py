import pytest
from pyspark.sql import functions as F

from palisade.operators import intent_blocks as ib
from palisade.operators import intent_model as im
from palisade.operators.intent_model import IntentModel
from palisade.sources.corpus import seed_samples


@pytest.fixture(scope="module")
def fitted(spark):
    return ib.train_by_blocks(spark=spark, tol=1e-8, block=300)


def test_same_optimum_as_the_seed_fit(seed, fitted):
    assert (fitted.n_grams, fitted.n_samples) == (seed.n_grams, seed.n_samples)
    both = seed.grams.alias("a").join(fitted.grams.alias("b"), "gram")
    n, weight, idf = both.agg(
        F.count("*"), F.max(F.abs(F.col("a.weight") - F.col("b.weight"))), F.max(F.abs(F.col("a.idf") - F.col("b.idf")))
    ).first()
    assert n == seed.n_grams and weight < 1e-6 and idf < 1e-12
    assert fitted.intercept == pytest.approx(seed.intercept, abs=1e-6)


def test_certificate_tells_the_optimum_from_a_shifted_weight(spark, seed, fitted):
    samples = seed_samples(spark)
    for model in (seed, fitted):
        row = ib.certificate(model, samples).first()
        assert (row["n_grams"], row["n_samples"]) == (1994, 40) and row["gradient"] < 1e-4
    shifted = seed.grams.withColumn("weight", F.col("weight") + F.when(F.col("gram") == "ig", 1e-2).otherwise(0.0))
    assert ib.certificate(IntentModel(shifted, seed.intercept, 1994, 40), samples).first()["gradient"] > 1e-3
    assert ib.certificate(IntentModel(seed.grams, seed.intercept + 1e-2, 1994, 40), samples).first()["gradient"] > 1e-3


def test_odd_samples_and_one_label(spark):
    rows = [("", 1), (None, 1), ("ab ab", None), ("good day", 0), ("bad day " * 2000, 1), ("good day", 0), (" \n", 0)]
    samples = spark.createDataFrame(rows, "text string, label int")
    model = ib.train_by_blocks(samples, block=8)
    assert model.n_samples == 5 and ib.certificate(model, samples).first()["gradient"] < 1e-4
    with pytest.raises(ValueError):
        ib.train_by_blocks(samples.filter("label = 1"))


def test_a_step_is_one_job_of_a_few_stages(spark):
    sc, seen = spark.sparkContext, []
    for steps in (2, 6):
        sc.setJobGroup(f"steps {steps}", "")
        ib.train_by_blocks(seed_samples(spark), max_iter=steps, tol=0.0)
        seen.append(len(sc.statusTracker().getJobIdsForGroup(f"steps {steps}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert seen[1] - seen[0] <= 4 + 1  # and one, where a step has to be halved


def test_many_characters_are_fitted_without_vectors(spark, seed, monkeypatch):
    def refused(*a, **b):
        raise AssertionError("vectors of all samples")

    monkeypatch.setattr(im, "_vectors_by_broadcast", refused)
    monkeypatch.setattr(im, "_vectors_by_join", refused)
    monkeypatch.setattr(im, "MAX_VECTOR_CHARS", 500, raising=False)
    model = im.train(spark=spark)
    weight, n = model.grams.alias("a").join(seed.grams.alias("b"), "gram").agg(
        F.max(F.abs(F.col("a.weight") - F.col("b.weight"))), F.count("*")
    ).first()
    assert n == seed.n_grams == model.n_grams and model.n_samples == 40
    assert weight < 1e-4 and model.intercept == pytest.approx(seed.intercept, abs=1e-4)


def test_the_path_of_written_blocks_is_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ib, "WRITTEN", 2)
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    ib.train_by_blocks(seed_samples(spark), max_iter=5, tol=0.0)
    if before:
        sc._jsc.sc().setCheckpointDir(before)
    assert not [x for x in tmp_path.rglob("rdd-*")]

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from palisade.functions.gram_filter import GramFilter, filter_bits
from palisade.operators.evaluate import settings_sweep
from palisade.operators.intent_features import term_frequencies
from palisade.operators.intent_score import score_by_join

SETTINGS = "setting_id long, intent_threshold double, block_on_sanitizer boolean, block_on_intent boolean"


def test_settings_against_a_plain_count(spark, plan_of):
    draw = random.Random(1)
    scores = [0.0, 1.0, 0.5, 0.25, 1 / 3, 0.5 + 2**-20] + [draw.random() for _ in range(60)]
    rows = [(draw.choice([True, False, None]), draw.choice(scores)) for _ in range(900)] + [(True, None)]
    levels = [0.0, 1.0, 0.5, 0.25, -0.5, 1.5, None] + draw.sample(scores, 20) + [draw.random() for _ in range(20)]
    wanted = [(i, t, draw.choice([True, False, None]), draw.choice([True, False, None])) for i, t in enumerate(levels * 3)]
    found = settings_sweep(spark.createDataFrame(rows, "high boolean, score double"), spark.createDataFrame(wanted, SETTINGS))
    expected = {}
    for i, t, scans, blocks in wanted:
        t, scans, blocks = 0.5 if t is None else t, scans is not False, blocks is not False
        known = [(bool(h), s) for h, s in rows if s is not None]
        l1 = sum(scans and h for h, _ in known)
        l3 = sum(not (scans and h) and blocks and s >= t for h, s in known)
        expected[i] = (len(known), l1, l3, len(known) - l1 - l3)
    assert {r["setting_id"]: (r["total"], r["l1_blocked"], r["l3_blocked"], r["allowed"]) for r in found.collect()} == expected
    assert "CartesianProduct" not in plan_of(found) and "NestedLoop" not in plan_of(found)


def test_settings_over_no_rows(spark):
    settings = spark.createDataFrame([(1, 0.3, True, True), (2, None, None, None)], SETTINGS)
    rows = settings_sweep(spark.createDataFrame([], "high boolean, score double"), settings).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]
    assert settings_sweep(spark.createDataFrame([(True, 0.4)], "high boolean, score double"), settings.limit(0)).count() == 0


def test_filter_knows_every_gram_and_few_others(spark):
    draw = random.Random(2)
    words = ["".join(draw.choice("abcdeé\U0001f600 ") for _ in range(draw.randrange(2, 5))) for _ in range(3000)]
    inside, outside = set(words[:1500]), set(words[1500:]) - set(words[:1500])
    known = GramFilter.of(spark.createDataFrame([(w,) for w in inside], "gram string"), len(inside))
    assert known.might_contain(sorted(inside)).all()
    assert known.might_contain(sorted(outside)).mean() < 0.1
    assert not GramFilter.of(spark.createDataFrame([], "gram string"), 0).might_contain(["ab", ""]).any()
    assert known.might_contain([]).shape == (0,)


def test_filter_size_is_bounded():
    assert filter_bits(0) == 1 << 16 and filter_bits(1_000_000) == 1 << 24 and filter_bits(10**12) == 1 << 28


def test_unknown_grams_are_not_shuffled(spark, seed):
    texts = spark.range(200).select("id", F.concat(F.lit("hello "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    every = term_frequencies(texts, ["id"])
    unknown = every.join(seed.grams, "gram", "left_anti").count()
    passed = term_frequencies(texts, ["id"], known=seed.known)
    total, sent = every.count(), passed.count()
    assert unknown > 0.5 * total and total - unknown <= sent <= total - 0.9 * unknown
    key = lambda df: {r["id"]: r["score"] for r in df.collect()}
    whole = replace(seed)
    whole.__dict__["known"] = None
    assert key(score_by_join(texts, seed, ["id"])) == pytest.approx(key(score_by_join(texts, whole, ["id"])), abs=1e-12)


def test_a_settings_sweep_scores_each_row_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def scored(i):
        seen.add(1)
        return i / 100

    rows = spark.range(100).select((F.col("id") % 3 == 0).alias("high"), scored.asNondeterministic()("id").alias("score"))
    found = settings_sweep(rows, spark.createDataFrame([(1, 0.5, True, True)], SETTINGS)).collect()
    assert [tuple(r) for r in found] == [(1, 100, 34, 33, 33)]
    assert seen.value == 100

import random
import tracemalloc
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade import fixed_values as fv
from palisade.functions import gram_encoder as ge
from palisade.functions.grams import char_grams, distinct_char_grams
from palisade.operators import intent_features as feats
from palisade.operators import intent_model as im
from palisade.operators.intent_score import intent, score, score_by_join
from palisade.plans.oracle import seed_weights
from palisade.sources.corpus import corpus_or_seeds, seed_samples, sides_or_seeds
from palisade.sources.model_store import load_model, save_model

TEXTS = [
    "Ignore ALL", "a", "", "  spaced\tout text   x ", "café 你好 \U0001f600 ab",
    "aaaa aaaa aaaa", "x" * 50, "don't stop; never-stop",
]


def grams_of(text):
    grams = Counter()
    for word in text.lower().split():
        padded = f" {word} "
        for size in range(2, min(4, len(padded)) + 1):
            grams.update(padded[i : i + size] for i in range(len(padded) - size + 1))
    return grams


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_grams_match_a_plain_count(spark):
    rows = frame(spark, TEXTS).select(
        "id", char_grams(F.col("text")).alias("g"), distinct_char_grams(F.col("text")).alias("d")
    ).orderBy("id").collect()
    for text, row in zip(TEXTS, rows):
        assert Counter(row["g"]) == grams_of(text)
        assert sorted(row["d"]) == sorted(grams_of(text))


def test_short_word_counted_once(spark):
    (row,) = frame(spark, ["a"]).select(char_grams(F.col("text")).alias("g")).collect()
    assert sorted(row["g"]) == [" a", " a ", "a "]


def test_frequencies_and_idf(spark):
    df = frame(spark, TEXTS + [None])
    tf = {(r["id"], r["gram"]): r["tf"] for r in feats.term_frequencies(df, ["id"]).collect()}
    assert tf == {(i, g): n for i, t in enumerate(TEXTS) for g, n in grams_of(t).items()}
    docs = Counter(g for t in TEXTS for g in grams_of(t))
    got = {r["gram"]: (r["df"], r["idf"]) for r in feats.gram_idf(df).collect()}
    assert set(got) == set(docs)
    for gram, n in docs.items():
        assert got[gram][0] == n
        assert got[gram][1] == pytest.approx(np.log((1 + len(TEXTS)) / (1 + n)) + 1, abs=1e-12)


def test_balanced_class_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 9, "label int")
    got = {r["label"]: (r["n"], r["weight"]) for r in feats.class_weights(df).collect()}
    assert got == {1: (3, 2.0), 0: (9, 12 / 18)}


@pytest.mark.parametrize("block, group", [(ge._BLOCK_CHARS, ge._ROW_GROUP_CHARS), (7, 20), (64, 1)])
def test_encoder_counts_across_blocks(monkeypatch, block, group):
    monkeypatch.setattr(ge, "_BLOCK_CHARS", block)
    monkeypatch.setattr(ge, "_ROW_GROUP_CHARS", group)
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["ab", "abc", "zz", "été", "q"]) for _ in range(40)) for _ in range(20)]
    texts = [t.lower() for t in texts]
    grams = sorted(set().union(*map(grams_of, texts[::2])))
    weights = np.linspace(-1, 1, len(grams))
    idf = np.linspace(1, 3, len(grams))
    encoder = ge.GramEncoder(grams, idf, weights)
    at = {g: i for i, g in enumerate(grams)}
    indices, values = encoder.sparse_rows(texts)
    dots = encoder.dot(texts)
    assert len(indices) == len(values) == len(dots) == len(texts)
    for i, text in enumerate(texts):
        expected = {at[g]: (1 + np.log(n)) * idf[at[g]] for g, n in grams_of(text).items() if g in at}
        norm = np.sqrt(sum(v * v for v in expected.values())) or 1
        assert dict(zip(indices[i].tolist(), values[i])) == pytest.approx({k: v / norm for k, v in expected.items()})
        assert dots[i] == pytest.approx(sum(v / norm * weights[k] for k, v in expected.items()), abs=1e-12)


@pytest.mark.parametrize("limit", [0xFFFF, 5])
@pytest.mark.parametrize("block, group", [(ge._BLOCK_CHARS, ge._ROW_GROUP_CHARS), (7, 20)])
def test_counting_without_a_vocabulary(monkeypatch, limit, block, group):
    monkeypatch.setattr(ge, "MAX_ALPHABET", limit)  # 5: too many characters for ids
    monkeypatch.setattr(ge, "_BLOCK_CHARS", block)
    monkeypatch.setattr(ge, "_ROW_GROUP_CHARS", group)
    texts = [t.lower() for t in TEXTS] + ["", "  "]
    counted = [Counter() for _ in texts]
    for rows, grams, tf in ge.gram_counts(texts):
        for row, gram, n in zip(rows.tolist(), grams, tf.tolist()):
            counted[row][gram] += n
    assert counted == [grams_of(t) for t in texts]
    documents = Counter()
    for grams, n in ge.gram_document_counts(texts):
        documents.update(dict(zip(grams, n.tolist())))
    assert documents == Counter(g for t in texts for g in grams_of(t))
    assert list(ge.gram_counts([])) == []


def test_encoder_with_no_texts_and_no_hits():
    encoder = ge.GramEncoder(["zz"], np.ones(1), np.ones(1))
    assert encoder.dot([]).tolist() == [] and encoder.dot(["", "abc"]).tolist() == [0.0, 0.0]


def test_seed_model_matches_an_independent_solver(seed):
    weights, intercept = seed_weights()
    assert seed.n_grams == len(weights) == 1994 and seed.n_samples == 40
    ours = {r["gram"]: (r["idf"], r["weight"]) for r in seed.grams.collect()}
    assert seed.intercept == pytest.approx(intercept, abs=1e-6)
    for gram, idf, weight in weights:
        assert ours[gram] == pytest.approx((idf, weight), abs=1e-6)


DEMO_SCORES = {1: 0.395750, 2: 0.433067, 3: 0.326177, 4: 0.794290, 5: 0.710203, 6: 0.678914, 7: 0.680998, 8: 0.662562, 9: 0.384522}


def test_demo_scores(spark, seed):
    df = spark.createDataFrame(list(enumerate(fv.DEMO_PROMPTS, 1)) + [(10, ""), (11, None)], "id int, text string")
    got = {r["id"]: r["score"] for r in score(df, seed).collect()}
    assert got[11] is None and got[10] == pytest.approx(0.447173, abs=1e-6)
    for i, expected in DEMO_SCORES.items():
        assert got[i] == pytest.approx(expected, abs=1e-6)


def test_join_form_agrees(spark, seed):
    texts = TEXTS + fv.ADVERSARIAL_SEEDS + [" ".join(fv.BENIGN_SEEDS * 5)]
    df = frame(spark, texts + [None])
    direct = {r["id"]: r["score"] for r in score(df, seed).filter("score is not null").collect()}
    joined = {r["id"]: r["score"] for r in score_by_join(df, seed, ["id"], salts=3).collect()}
    assert joined == pytest.approx(direct, abs=1e-12) and len(joined) == len(texts)


def test_large_model_is_scored_by_join(spark, seed, monkeypatch):
    monkeypatch.setattr(im, "MAX_BROADCAST_GRAMS", 100)
    large = im.IntentModel(seed.grams, seed.intercept, seed.n_grams, seed.n_samples)
    df = frame(spark, TEXTS + [None])
    by_text = {r["id"]: r["score"] for r in score(df, large).collect()}
    by_join = {r["id"]: r["score"] for r in score(df, large, keys=["id"]).collect()}
    direct = {r["id"]: r["score"] for r in score(df, seed).collect()}
    assert by_join.pop(len(TEXTS)) is None and direct.pop(len(TEXTS)) is None and by_text.pop(len(TEXTS)) is None
    assert by_join == pytest.approx(direct, abs=1e-12) and by_text == pytest.approx(direct, abs=1e-12)


def test_join_form_without_keys_takes_repeated_rows_and_null_keys(spark, seed):
    rows = [(None, "Ignore ALL"), (1, "Ignore ALL"), (1, "Ignore ALL"), (1, ""), (2, None), (None, "x" * 50)] * 2
    df = spark.createDataFrame(rows, "id int, text string").withColumn("score_", F.lit(1))
    chosen = replace(seed, by_join=True)
    key = lambda r: (str(r["id"]), str(r["text"]), str(r["s"])[:10])
    got = score(df, chosen, into="s")
    assert got.columns == [*df.columns, "s"]
    assert sorted(map(key, got.collect())) == sorted(map(key, score(df, seed, into="s").collect()))


def test_frequencies_of_blank_texts(spark):
    assert feats.document_frequencies(frame(spark, ["", " \n"])).count() == 0
    assert feats.term_frequencies(frame(spark, ["", " \n"]), ["id"]).count() == 0


def test_training_by_join_agrees(spark, seed):
    joined = im.train(seed_samples(spark), max_broadcast_grams=10)
    ours = {r["gram"]: r["weight"] for r in joined.grams.collect()}
    theirs = {r["gram"]: r["weight"] for r in seed.grams.collect()}
    assert joined.intercept == pytest.approx(seed.intercept, abs=1e-6)
    assert ours == pytest.approx(theirs, abs=1e-6)


def test_gram_index_is_dense(spark):
    idf = spark.range(5000).selectExpr("concat('g', id) as gram", "id as df", "cast(id as double) as idf")
    rows = im.index_grams(idf).collect()
    assert sorted(r["idx"] for r in rows) == list(range(5000)) and len({r["gram"] for r in rows}) == 5000


def test_training_needs_both_classes(spark):
    with pytest.raises(ValueError):
        im.train(spark.createDataFrame([("a", 1), ("b", 1)], "text string, label int"))


def test_no_samples_means_the_seeds(spark):
    empty = spark.createDataFrame([], "text string, label int")
    assert corpus_or_seeds(spark, empty).count() == corpus_or_seeds(spark, None).count() == 40
    assert corpus_or_seeds(spark, spark.createDataFrame([("a", 1)], "text string, label int")).count() == 1


def test_training_on_caller_samples_with_nulls_and_gramless_text(spark):
    rows = [("attack now", 1), ("attack it", 1), ("hello you", 0), ("hello there", 0), ("", 0), (None, 1), ("lost", None)]
    df = spark.createDataFrame(rows, "text string, label int")
    model = im.train(df)
    assert model.n_samples == 5
    got = [r["score"] for r in score(spark.createDataFrame([(1, "attack"), (2, "hello")], "id int, text string"), model).orderBy("id").collect()]
    assert got[0] > 0.5 > got[1]


def test_intent_label_is_inclusive_at_the_threshold(spark):
    df = spark.createDataFrame([(0.5,), (0.49999,), (None,)], "score double")
    rows = [r["p"] for r in df.select(intent(F.col("score"), 0.5).alias("p")).collect()]
    assert (rows[0]["label"], rows[0]["confidence"]) == ("adversarial", 0.5)
    assert (rows[1]["label"], rows[1]["confidence"]) == ("benign", pytest.approx(0.50001))
    assert rows[2] is None


def test_save_and_load(spark, seed, tmp_path):
    save_model(None, str(tmp_path / "model"), spark)
    loaded = load_model(spark, str(tmp_path / "model"))
    df = frame(spark, TEXTS)
    assert (loaded.intercept, loaded.n_grams) == (seed.intercept, seed.n_grams)
    assert score(df, loaded).collect() == score(df, seed).collect()


def test_scoring_needs_no_shuffle(spark, seed, plan_of):
    plan = plan_of(score(spark.range(3).selectExpr("cast(id as string) as text"), seed))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_invalid_utf8_is_scored_like_its_replacement(spark, seed):
    df = spark.sql("select 1 as id, cast(unhex('61FF62') as string) as text union all select 2, 'a\ufffdb'")
    first, second = score(df, seed).orderBy("id").collect()
    assert first["score"] == second["score"]


def test_one_side_given_the_other_from_the_seeds(spark):
    mine = spark.createDataFrame([("zqxj zqxj",), ("zqxj wvk",)], "text string")
    given = sides_or_seeds(spark, mine, None)
    assert {r["text"] for r in given.filter("label = 1").collect()} == {"zqxj zqxj", "zqxj wvk"}
    assert given.filter("label = 0").count() == len(fv.BENIGN_SEEDS)
    assert sides_or_seeds(spark, mine.limit(0), None).count() == len(fv.BENIGN_SEEDS) + len(fv.ADVERSARIAL_SEEDS)
    model = im.train(spark=spark, adversarial=mine)
    assert model.n_samples == 2 + len(fv.BENIGN_SEEDS)


def test_counting_takes_memory_for_a_group_of_texts_only():
    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5_000)]
    texts = [" ".join(draw.choices(words, k=500)) for _ in range(1_200)]  # 4 million characters
    tracemalloc.start()
    found = sum(int(n.sum()) for _, n in ge.gram_document_counts(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == sum(len({w[i : i + n] for w in (f" {x} " for x in set(t.split())) for n in (2, 3, 4) for i in range(len(w) - n + 1)}) for t in texts)
    assert peak < 250e6

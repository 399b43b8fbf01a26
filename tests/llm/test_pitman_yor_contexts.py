"""Contexts are whole words: what a word predicts is learnt, whatever its last byte."""

import random

from palisade.llm import pitman_yor as P

FOLDER = "/root/testdata/sf0.01"


def held_perplexity(scored):
    return next(r for r in P.perplexity(scored).collect() if r["held_out"])


def test_next_word_follows_from_the_word_before(spark):
    rng = random.Random(3)
    # The second word of a pair follows from the first; all words end in one byte.
    texts = [" ".join(f"a{k}x b{k}x" for k in rng.choices(range(100), k=100)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = held_perplexity(P.score_documents(docs))
    # Half of the tokens are drawn from 100, the others are certain: about 10 a token.
    assert out["perplexity"] < 15 and out["base_perplexity"] > 100


def test_held_out_perplexity_of_documents(spark):
    out = held_perplexity(P.score_documents(spark.read.parquet(f"{FOLDER}/documents.parquet")))
    assert out["perplexity"] < 0.5 * out["base_perplexity"]

"""Repeated byte strings against brute force over all windows."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from palisade.llm import queries, suffix_dedup as S

FOLDER = "/root/testdata/sf0.001"


def slow(rows):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + 400] for _, t in texts for i in range(len(t) - 399))
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def words(rng, n):
    return " ".join(rng.choice(["le", "thing", "ñandú", "of", "over", "été", "and", "wort", "zug"]) + str(rng.randrange(900)) for _ in range(n))


def corpus(seed=0):
    """Passages of all lengths around the limit, with other text on both sides, copies, near copies and periods."""
    rng = random.Random(seed)
    rows = []
    for length in (398, 399, 400, 401, 450, 655, 656, 700, 1500, 3000):
        passage = words(rng, 900)[:length]
        rows += [words(rng, rng.randrange(90)) + passage + words(rng, rng.randrange(90)) for _ in range(rng.choice([2, 3]))]
        rows.append(passage[rng.randrange(50) :] + words(rng, 20))
    copy = words(rng, 300)
    rows += [copy] * 3 + [copy[:700] + "!" + copy[701:], copy[:1200] + "?" + copy[1201:], copy[100:1400]]
    hot = words(rng, 80)[:520]
    rows += [words(rng, 12) + hot + words(rng, 12) for _ in range(40)]
    rows += ["a" * 1200, "ab" * 700, "", None, "x" * 400, "short"]
    return [(i, t) for i, t in enumerate(rows)]


def test_anchors_are_those_of_the_definition():
    data = words(random.Random(1), 700).encode()
    place, first, last, _ = S.anchors(data)
    assert first[0] == 0 and last[-1] == len(data) - 400 and (first[1:] == last[:-1] + 1).all()
    assert ((place - first) < S.SPAN).all() and (place >= last).all()
    # The anchor of a window doesn't depend on what lies around it.
    window = data[1000:1400]
    own = S.anchors(window)[0][0] + 1000
    assert own == place[(first <= 1000) & (last >= 1000)][0]


def test_shared_and_front_code():
    rng = random.Random(2)
    keys = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(90))) for _ in range(200))
    for a, b in zip(keys, keys[1:]):
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert S.shared(a, b) == n == S.shared(a, b, n // 2)
    assert [(k, p) for _, k, p in S.front_decoded(S.front_code(keys, keys))] == [(k, k) for k in keys]


@pytest.mark.parametrize("n_runs", [0, 1, 2, 3, 5, 8])
def test_loser_tree_merges_and_knows_what_is_shared(n_runs):
    rng = random.Random(n_runs)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(rng.randrange(60))) for _ in range(n_runs)]
    out = list(S.merge([S.front_decoded(S.front_code(r, [b""] * len(r))) for r in runs]))
    keys = [k for _, k, _ in out]
    assert keys == sorted(k for r in runs for k in r)
    assert all(common == S.shared(a, b) for a, (common, b, _) in zip(keys, out[1:]))


@pytest.mark.parametrize("seed, crowd", [(0, S.CROWD), (1, S.CROWD), (0, 5)])
def test_equals_brute_force(spark, seed, crowd):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("first", F.lit("mine"))
    assert sorted(map(tuple, S.repeated_bytes(docs, crowd).collect()), key=str) == slow(rows)


def test_repeated_and_null_ids_and_empty_tables(spark):
    text = words(random.Random(7), 200)
    rows = [(1, text), (1, text), (None, "lone"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.repeated_bytes(docs).collect()), key=str) == slow(rows)
    assert S.repeated_bytes(docs.limit(0)).count() == 0 == S.drop_repeats(docs.limit(0)).count()


def test_cut_texts_keep_whole_characters(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("_rest", F.lit(1))
    out = S.drop_repeats(docs.drop("_rest"))
    assert out.columns == ["doc_id", "text", "n_chars"] and out.count() == len(rows)
    assert out.filter(F.length("text") != F.col("n_chars")).count() == 0
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    removed = {d: n - k for d, n, k, *_ in slow(rows)}
    assert all(0 <= len((texts[d] or "").encode()) - left <= 400 for d, left in removed.items())


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, queries.QUERIES["op8_suffix_dedup"](spark, FOLDER).collect()), key=str)
    assert found == slow([(r["doc_id"], r["text"]) for r in docs])

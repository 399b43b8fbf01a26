"""Counts and base scores against brute force, normalisation, seating, and held-out perplexity."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import pitman_yor as P
from palisade.llm import queries

FOLDER = "/root/testdata/sf0.01"


def slow_base(rows):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        own = words(t)
        score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        out.append((str(d), held(d), len(own), sum(counts[w] > 0 for w in own), n, round(score, 6)))
    return sorted(out)


def found(rows):
    return sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


def test_query_counts_and_beats_the_base(spark):
    out = queries.QUERIES["op4_pitman_yor"](spark, FOLDER)
    out = spark.createDataFrame(out.collect(), out.schema)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert found(out.collect()) == slow_base([(r["doc_id"], r["text"]) for r in docs])
    for r in P.perplexity(out).collect():
        assert 1 < r["perplexity"] < 0.9 * r["base_perplexity"]
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out.collect())


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "A b c \x0b c"), (3, "A b c \x0b c"), (4, "x" * 5_000), (5, "the " * 20_000), (6, "Éa ß \x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("score", F.lit("mine"))
    out = P.score_documents(docs).collect()
    assert found(out) == slow_base(rows) and all(math.isfinite(r["score"]) for r in out)
    assert P.score_documents(docs.limit(0)).count() == 0
    only = docs.filter(P.held_out())  # nothing to learn from
    assert all(math.isfinite(r["score"]) for r in P.score_documents(only).collect())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 2_000, 300) * (rng.random(300) < 0.9) + 1
    state = P._State(np.arange(60, dtype="<u8"), np.repeat(np.arange(60), 5), np.tile(np.arange(5), 60), counts, np.ones(300, np.int64), np.ones(60, np.int64))
    context = lambda x: np.bincount(state.context, x, P.CONTEXTS).astype(np.int64)
    for _ in range(3):
        totals = P.Totals(context(counts), context(state.tables), int(state.parents.sum()), 60, 0.6, 0.5)
        per_word = np.bincount(state.word, state.tables)
        parent = totals.parent(np.append(per_word, 0), np.append(state.parents, 0))
        assert abs(parent.sum() - 1) < 1e-9
        known = totals.cell(state.context, counts, state.tables, parent[state.word])
        sums = np.bincount(state.context, known, P.CONTEXTS)[:5]
        unknown = totals.cell(np.arange(5), np.zeros(5), np.zeros(5), np.full(5, parent[-1]))
        assert np.abs(sums + unknown - 1).max() < 1e-9
        dish = totals.parent_without(per_word[state.word], state.parents[state.word], state.tables)
        state.tables = P.seat(counts, totals.tables[state.context] - state.tables, dish, totals.discount, rng)
        assert (state.tables >= 1).all() and (state.tables <= counts).all()
        others = state.parents.sum() - state.parents
        state.parents = P.seat(np.bincount(state.word, state.tables).astype(np.int64), others, np.full(60, 1 / 61), 0.5, rng)


@pytest.mark.parametrize("count", [5, 400, 3_000])
def test_mean_number_of_tables(count):
    # A Pitman-Yor restaurant whose base always gives a new dish: E[t] by the recursion of its means.
    strength = 2.0
    rng = np.random.default_rng(0)
    draws = P.seat(np.full(4_000, count), np.zeros(4_000), np.ones(4_000), 0.0, rng, strength)
    expected = sum(strength / (strength + k) for k in range(count))
    assert abs(draws.mean() / expected - 1) < 0.03


def seatings(n):
    """Sizes of the tables of every way to seat n customers."""
    if n == 0:
        yield []
        return
    for sizes in seatings(n - 1):
        yield [*sizes, 1]
        for k in range(len(sizes)):
            yield [*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]]


def weight(sizes, d):
    """Of the customers that join a table which is there."""
    return math.prod(math.prod(k - d for k in range(1, n)) for n in sizes)


def test_gibbs_draws_follow_the_exact_distribution():
    # A restaurant with three words: the joint distribution of their tables by listing all seatings.
    counts, dish, d, strength = [3, 4, 2], [0.3, 0.05, 0.2], 0.4, P.STRENGTH
    ways = [Counter() for _ in counts]
    for w, c in zip(ways, counts):
        for sizes in seatings(c):
            w[len(sizes)] += weight(sizes, d)
    exact = {}
    for a in ways[0]:
        for b in ways[1]:
            for c in ways[2]:
                paid = math.prod(strength + d * i for i in range(a + b + c))
                exact[a, b, c] = ways[0][a] * ways[1][b] * ways[2][c] * paid * math.prod(p**t for p, t in zip(dish, (a, b, c)))
    whole = sum(exact.values())
    # Many chains side by side, one word after the other.
    rng, chains = np.random.default_rng(2), 40_000
    tables = np.ones((3, chains), np.int64)
    for _ in range(12):
        for k in range(3):
            tables[k] = P.seat(np.full(chains, counts[k]), tables.sum(axis=0) - tables[k], np.full(chains, dish[k]), d, rng)
    found = Counter(map(tuple, tables.T.tolist()))
    assert all(abs(found[t] / chains - p / whole) < 0.012 for t, p in exact.items())


def test_ways_to_seat():
    rows = P.stirling(6, 0.4)
    for c in range(1, 7):
        by_tables = Counter()
        for sizes in seatings(c):
            by_tables[len(sizes)] += weight(sizes, 0.4)
        assert np.allclose(np.exp(rows[c]), [by_tables[t] for t in range(1, c + 1)])


def test_squeeze_round_trip():
    a, b = np.arange(1000, dtype="<u4"), np.array([1.5, -2.25], "<f4")
    back = P._loosen(P._squeeze(a, b, a[:0]), ("<u4", 1000), ("<f4", 2), ("<u4", 0))
    assert (back[0] == a).all() and (back[1] == b).all() and len(back[2]) == 0

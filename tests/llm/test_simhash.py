"""Fingerprints, the Gray-order index and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palisade.llm import gray_index, queries, simhash
from palisade.llm.components import components

FOLDER = "/root/testdata/sf0.001"


def slow_fingerprint(text, width=3):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def near(a, b):
    return (a ^ b).bit_count() <= 3


def slow_near_duplicates(rows):
    codes = {c: min(d for d, x in rows if x == c) for c in {x for _, x in rows}}
    both = list(codes)
    tops = slow_components(both, [(a, b) for i, a in enumerate(both) for b in both[:i] if near(a, b)])
    first = {}
    for c, top in tops.items():
        first[top] = min(first.get(top, codes[c]), codes[c])
    return sorted((d, f"{c:016x}", first[tops[c]]) for d, c in rows)


def clusters(n, seed=0, noise=14):
    """Codes in dense clusters, one of them large, and some at random."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    bits = [rng.sample(range(64), noise) for _ in centres]
    out = set()
    while len(out) < n:
        k = 0 if rng.random() < 0.6 else rng.randrange(5)
        code = centres[k]
        for b in bits[k]:
            code ^= rng.getrandbits(1) << b
        out.add(code if rng.random() < 0.9 else rng.getrandbits(64))
    return sorted(out)


@pytest.mark.parametrize("text", ["", " \n", "One", "a B", "a b c", "a b c d A b C", "é ß x 中 y z", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_index_finds_all_pairs():
    codes = np.array(clusters(900), np.uint64)
    codes = codes[np.argsort(gray_index.gray_rank(codes))]
    wanted = {(i, j) for i in range(900) for j in range(i + 1, 900) if near(int(codes[i]), int(codes[j]))}
    index = gray_index.build(codes)
    assert set(zip(*[x.tolist() for x in gray_index.search(index, index, 3, True)])) == wanted
    one, two = gray_index.build(codes[:400]), gray_index.build(codes[400:])
    across = {(i, j - 400) for i, j in wanted if i < 400 <= j}
    assert set(zip(*[x.tolist() for x in gray_index.search(one, two, 3, False)])) == across


def test_gray_rank_of_neighbours():
    n = np.arange(1000, dtype=np.uint64)
    assert (gray_index.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("cell", [4096, 64])
def test_links_connect_what_brute_force_connects(spark, cell):
    codes = clusters(1500, seed=2)
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(frame, cell).collect()]
    assert all(a in set(codes) and b in set(codes) for a, b in found)
    wanted = slow_components(codes, [(a, b) for i, a in enumerate(codes) for b in codes[:i] if near(a, b)])
    assert slow_components(codes, found) == wanted


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, n) for n in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    rng.shuffle(edges)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    tops = {n: n for n in nodes} | {r["node"]: r["root"] for r in rows}
    assert tops == slow_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = sorted(map(tuple, queries.QUERIES["op1_simhash"](spark, FOLDER).collect()))
    assert found == slow_near_duplicates([(r["doc_id"], slow_fingerprint(r["text"] or "")) for r in docs])


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(5, text), (3, text.upper()), (None, text), (9, None), (8, ""), (8, ""), (None, "lone words here"), (1, "other thing entirely " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("x")).withColumn("kept", F.lit(1))
    out = simhash.near_duplicates(docs).select("doc_id", "component_id", "kept").collect()
    by_id = {(r["doc_id"], r["component_id"]) for r in out}
    assert by_id == {(5, 3), (3, 3), (None, 3), (9, 8), (8, 8), (None, None), (1, 1)} and len(out) == len(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "8", "None"]
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0

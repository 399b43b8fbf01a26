import random
import re
import zlib
from collections import Counter

import pytest

from palisade.llm import spelling_variants as sv

SCHEMA = "doc_id long, text string"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = top if top and counts[top] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def brute(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return brute_variants({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def documents(seed, n_docs, n_words):
    draw = random.Random(seed)
    stems = ["".join(draw.choice("abcdeéÿ") for _ in range(draw.randrange(5, 9))) for _ in range(40)]
    words = stems + [s[:k] + draw.choice("abz×") + s[k + draw.randrange(2) :] for s in stems for k in (0, 2, 4, 5)]
    weights = [draw.random() ** 6 for _ in words]
    text = lambda: " ".join(w.upper() if draw.random() < 0.1 else w for w in draw.choices(words, weights, k=n_words))
    return [(i, text()) for i in range(n_docs)]


def test_equals_brute_force(spark):
    docs = documents(1, 60, 200) + [(None, "Überfluß überfluß " * 9), (7, None), (7, ""), (8, "a" * 200_000), (9, "naïveté-naïvete " * 70_000)]
    docs += docs[:5]
    expected = brute(docs)
    assert any(x[0] for x in expected.values())
    assert found(sv.misspelt_variants(spark.createDataFrame(docs, SCHEMA))) == expected


@pytest.mark.parametrize("pairs", [0, 40, 10_000])
def test_common_chunks_lose_no_link(spark, pairs):
    draw = random.Random(2)
    words = {"prefix" + "".join(draw.choice("abc") for _ in range(draw.randrange(2, 7))) for _ in range(400)}
    words |= {"".join(draw.choice("abc") for _ in range(draw.randrange(2, 6))) + "ending" for _ in range(200)}
    words |= {w[:3] + "x" + w[3:] for w in sorted(words)[::7]}
    counts = {w: draw.choice([5, 6, 30, 31, 200, 1200]) for w in words}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(sv.variants(df, pairs=pairs)) == brute_variants(counts)


def test_chains_of_forms_and_ties(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "zaaaaa": 25, "qqqqqq": 9, "qqqqqr": 9}
    rows = found(sv.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert rows == brute_variants(counts)
    assert rows["aaaaaa"][:2] == ("aaaaab", "aabbbb") and rows["qqqqqq"][0] is None


def test_empty_table_and_clashing_names(spark):
    assert sv.misspelt_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = documents(3, 20, 80)
    names = ["word", "n", "key", "size", "head", "tail", "pairs", "chunks", "root", "form", "h", "other", "next", "node", "_llm_row"]
    wide = spark.createDataFrame([(*d, *["zzzzzz"] * len(names)) for d in docs], SCHEMA + "".join(f", {c} string" for c in names))
    assert found(sv.misspelt_variants(wide)) == brute(docs)

"""The near-duplicate stage against brute-force Jaccard, with planted copies."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import near_dedup, simhash
from palisade.llm.common import row_keyed
from tests.llm.test_simhash import slow_components

FOLDER = "/root/testdata/sf0.001"


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(docs):
    sets = {d: slow_shingles(t) for d, t in docs.items()}
    ids = sorted(docs)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    return slow_components(ids, pairs), pairs, sets


def planted():
    """Texts with copies at 0.8 to 0.95, a chain of edits, a template, and texts without five words."""
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    docs, copies = {}, []
    for base in range(60):
        words = [word() for _ in range(rng.randrange(100, 600))]
        docs[len(docs)] = " ".join(words)
        for goal in (0.8, 0.83, 0.87, 0.91, 0.95):
            # Each new word breaks five shingles.
            own, n = list(words), len(words) - 4
            for at in rng.sample(range(5, len(words) - 5), max(1, int(n * (1 - goal) / (1 + goal) / 5))):
                own[at] = word()
            docs[len(docs)] = " ".join(own)
            copies.append((base * 6, len(docs) - 1))
    chain = [word() for _ in range(300)]
    for step in range(0, 290, 7):
        chain[step : step + 7] = [word() for _ in range(7)]
        docs[len(docs)] = " ".join(chain)
    shared = [word() for _ in range(200)]
    for _ in range(40):
        docs[len(docs)] = " ".join(shared + [word() for _ in range(150)])
    for text in ("a b", "A  b", "a b c", "", " \n", None, "a b c d e f"):
        docs[len(docs)] = text
    return docs, copies


def test_planted_copies_are_one_group(spark):
    docs, copies = planted()
    wanted, pairs, sets = slow_groups(docs)
    similar = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in copies]
    assert min(similar) < 0.82 and max(similar) > 0.94 and sum(x >= 0.8 for x in similar) >= 280
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(row_keyed(frame)).collect()}
    assert found == wanted
    kept = corpus_pipeline.near(spark, frame, "")
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({*wanted.values()})


def test_documents_against_brute_force(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    wanted, pairs, _ = slow_groups({r["doc_id"]: r["text"] for r in frame.collect()})
    assert pairs
    assert sorted(r["doc_id"] for r in corpus_pipeline.near(spark, frame, FOLDER).collect()) == sorted({*wanted.values()})
    assert corpus_pipeline.near(spark, frame.limit(0), FOLDER).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two three four five six"), (None, "one two  three four five six"), (5, "x"), (5, "X"), (4, "x "), (None, "x")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"].split()[0]) for r in kept) == [("4", "x"), ("None", "one")]


def test_few_pairs_of_a_common_template(spark, monkeypatch):
    """Texts of one template at less than 0.8 aren't compared in pairs; two templates' copies are two groups."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = [word() for _ in range(400)]
    other = [word() if 100 < i < 115 or 200 < i < 215 else w for i, w in enumerate(template)]
    docs = []
    for base, edits, n in ((template, 9, 60), (template, 1, 30), (other, 1, 30)):
        for _ in range(n):
            own = list(base)
            for at in rng.sample(range(5, 395, 6), edits):
                own[at] = word()
            docs.append(" ".join(own))
    docs = dict(enumerate(docs))
    compared, verified = [], near_dedup._verified
    monkeypatch.setattr(near_dedup, "_verified", lambda pairs, sets: compared.append(pairs.count()) or verified(pairs, sets))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(row_keyed(frame)).collect()}
    wanted, _, _ = slow_groups(docs)
    assert found == wanted and len({*wanted.values()}) >= 20
    assert sum(compared[1:]) < 10 * len(docs)


def test_places_of_shared_differences(spark):
    """No pair at 0.8 or more is left out by the places of its shared differences, whatever the smallest member."""
    rng = random.Random(3)
    docs, pool = {}, [f"p{i}" for i in range(40)]
    for _ in range(150):
        words = [f"t{i}" for i in range(60)]
        start = rng.randrange(40)
        words[start : start + rng.randrange(1, 7)] = rng.sample(pool, rng.randrange(0, 7))
        docs[len(docs)] = " ".join(words[: rng.randrange(50, 61)])
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(row_keyed(frame)).collect()}
    assert found == slow_groups(docs)[0]


def test_texts_meet_through_the_fingerprint_index(spark, monkeypatch):
    """Without any common band, near texts of close fingerprints are one group still; close fingerprints alone link nothing."""
    rng = random.Random(13)
    word = lambda: f"w{rng.randrange(10**9)}"
    docs = {}
    for _ in range(12):
        words = [word() for _ in range(300)]
        for _ in range(4):
            docs[len(docs)] = " ".join(words)
            words[rng.randrange(5, 295)] = word()
    line = [word() for _ in range(61)]
    # The same shingles in most of the places, but most distinct ones in one of the texts only.
    docs |= {len(docs) + k: " ".join(line * 200 + [word() for _ in range(150)]) for k in range(2)}
    ids, sets = sorted(docs), {d: slow_shingles(t) for d, t in docs.items()}
    codes = {d: simhash.fingerprint(t.encode(), near_dedup.WIDTH) for d, t in docs.items()}
    close = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (codes[a] ^ codes[b]).bit_count() <= simhash.RADIUS]
    bucket = slow_components(ids, close)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if bucket[a] == bucket[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    wanted = slow_components(ids, linked)
    assert len(linked) > 10 and (ids[-1], ids[-2]) in close and wanted[ids[-1]] == ids[-1]
    sketched = near_dedup._sketched
    monkeypatch.setattr(near_dedup, "_sketched", lambda rows: sketched(rows).withColumn("bands", F.array("node")))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(row_keyed(frame)).collect()}
    assert found == wanted and len({*found.values()}) < len(docs) - 12

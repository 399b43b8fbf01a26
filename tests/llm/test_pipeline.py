"""The pipeline against a brute-force version, stage by stage; rules and exact dedup on odd rows."""

import random
from collections import Counter
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palisade.llm import exact_dedup, quality_rules
from tests.llm.test_simhash import slow_components
from tests.llm.test_tokens import check_packing, library

FOLDER = "/root/testdata/sf0.001"


def slow_rules(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    chars = sum(map(len, words))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    dup = len(lines) - len(set(lines))
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    upper = sum(c.isupper() for c in text or "")
    bad = base or 10 * symbols > len(words) or (dup >= 3 and 10 * dup > 3 * len(lines)) or upper > 0.5 * chars or chars > 30 * len(words)
    return len(words), chars, symbols, dup, len(covered), base, not bad


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = "one two three four five six seven " * 3_000
    rows = [(None, "a b " * 40, "en", "s", 1), (9_000_001, None, "en", "s", 1), (9_000_002, "", None, None, None)]
    rows += [(9_000_003, "same row", "en", "s", 1)] * 2 + [(9_000_004, long, "en", "s", 1), (9_000_005, "x\n" * 9 + "\x0b\x1f y", "e", "s", 1)]
    rows += [(9_000_006, "z" * 4096, "en", "s", 1), (9_000_007, "z" * 4097, "en", "s", 1), (9_000_008, "z" * 4096, "en", "s", 1)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(1))


def test_rules_on_odd_rows(odd):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    out = quality_rules.apply_policy(quality_rules.ledger(odd)).select("doc_id", *names).collect()
    wanted = [(r["doc_id"], *slow_rules(r["text"])) for r in odd.collect()]
    assert sorted(map(tuple, out), key=str) == sorted(wanted, key=str)
    kept = quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(w[-1] for w in wanted)
    assert quality_rules.filter_documents(odd.limit(0)).count() == 0


def test_ablation_counts(odd):
    rows = quality_rules.ledger(odd)
    masks = [r["fail_mask"] for r in rows.collect()]
    for r in quality_rules.ablation(rows).collect():
        bit = 1 << list(quality_rules.RULES).index(r["rule"])
        assert (r["n_docs"], r["n_kept"]) == (len(masks), masks.count(0))
        assert (r["n_failed"], r["n_failed_alone"]) == (sum(bool(m & bit) for m in masks), masks.count(bit))


@pytest.mark.parametrize("digest", [None, 3])
def test_exact_dedup_on_odd_rows(odd, monkeypatch, digest):
    if digest:  # digests that clash all the time: names must still be those of the contents
        weak = lambda block: [F.pmod(F.crc32(block), F.lit(digest)).alias("h1"), F.lit(0).cast("long").alias("h2")]
        monkeypatch.setattr(exact_dedup, "digest", weak)
    out = exact_dedup.exact_duplicates(odd, size=64).collect()
    groups = {}
    for r in odd.collect():
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    wanted = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        wanted += [(i, best, len(ids), sha256(text.encode()).hexdigest()) for i in ids]
    found = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    docs = exact_dedup.drop_duplicates(odd)
    assert docs.columns == odd.columns and docs.count() == len(groups)
    assert exact_dedup.exact_duplicates(odd.limit(0)).count() == 0


def slow_passages(texts, size):
    """Texts without repeated strings of ``size`` bytes, whole characters only."""
    seen = Counter(t[i : i + size] for t in texts.values() for i in range(len(t) - size + 1))
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        rest, at = [], 0
        for c in t.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                rest.append(c)
            at += n
        out[d] = "".join(rest)
    return out


def slow_shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    """Jaccard similarity of at least 0.8; sets without a shingle are equal."""
    return len(a & b) * 5 >= len(a | b) * 4


def test_pipeline_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    docs = {d: t for d, t in docs.items() if slow_rules(t)[-1]}
    last = {t: d for d, t in sorted(docs.items())}
    docs = {d: t for t, d in last.items()}
    sets = {d: slow_shingles(t) for d, t in docs.items()}
    ids = sorted(docs)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if alike(sets[a], sets[b])]
    assert pairs
    docs = {d: docs[d] for d, top in slow_components(ids, pairs).items() if d == top}
    docs = slow_passages({d: t.encode() for d, t in docs.items()}, corpus_pipeline.PASSAGE.length)
    out = corpus_pipeline.run(spark, FOLDER).collect()
    check_packing(out, 1024)
    lengths = {}
    for r in out:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    encoded = library("byte_bpe_50k.json")(list(docs.values()))
    assert lengths == {d: len(x) + 1 for d, x in zip(docs, encoded)}


def test_passages_of_fifty_short_words_are_caught(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 6)))
    said = lambda n: " ".join(word() for _ in range(n))
    planted = [said(n) for n in (52, 56, 60, 70) for _ in range(5)]
    texts = [f"{said(60)} {p} {said(60)}" for p in planted for _ in range(2)] + [said(150) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.passages(spark, df, FOLDER).collect()}
    caught = sum(planted[i // 2][30:-30] not in kept[i] for i in range(2 * len(planted)))
    assert caught >= 0.9 * 2 * len(planted) and all(kept[i] == texts[i] for i in range(2 * len(planted), len(texts)))


CLASHES = ["node", "_rest", "_doc", "_fid", "_row", "_llm_file", "_llm_row", "fid", "row", "value", "key", "label", "bands", "name"]


@pytest.mark.parametrize("rows", [0, 40])
def test_clashing_names(spark, rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(rows)
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, FOLDER)
        plain = {r["doc_id"]: r["text"] for r in stage(spark, docs, FOLDER).collect()}
        got = out.collect()
        assert out.columns == wide.columns and {r["doc_id"]: r["text"] for r in got} == plain and len(got) == len(plain), name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in CLASHES), name


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).dtypes == docs.dtypes

"""Encoders, token files and packing against the libraries themselves."""

import gc
import random
import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palisade.llm import byte_bpe, packing, queries, simple8b, token_files, units

FOLDER = "/root/testdata/sf0.001"
BITS = [
    " ", "  ", "\n", "\t", "a", "B", "'s", "'", "word", "Word,", "the.", ".", ",", "Ünï", "É", "1", "23", "!!", "中", "é",
    "<|endoftext|>", "́", "\x1c", "\x85", "İ", "Σ", "H", "̱", "\0", " \0 ", "zzzzzzzz",
]


def fuzz(n):
    rng = random.Random(3)
    return ["", " ", *["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(n)]]


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.fixture(scope="module")
def documents(spark):
    """The small table, with nulls, an empty text, a repeated row, a very long text and clashing names."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(None, "no id at all", "en", "s", 1), (7_000_001, None, None, None, None), (7_000_002, "", "en", "s", 0)]
    odd += [(7_000_003, "twice the same", "en", "s", 1)] * 2 + [(7_000_004, "ab " * 40_000 + "x" * 9_000, "en", "s", 1)]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("ids", F.lit("mine")).withColumn("piece", F.lit(9))


def rows_of(documents):
    return [(r["doc_id"], r["text"] or "") for r in documents.collect()]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library(name):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_two_tiers_equal_the_library_on_odd_texts(tiktoken_encoding):
    texts = [*fuzz(4_000), "a" * 3_000]
    coder = byte_bpe._coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert [ids(x) for x in coder.encode(texts)] == [tiktoken_encoding.encode_ordinary(t) for t in texts]


def test_small_memory_gives_the_same_ids():
    coder = units.UnitCoder(lambda texts: [list(t.encode()) for t in texts], limit=5)
    texts = [f"a{i % 7} b{i % 3} a{i % 5}" for i in range(50)]
    assert [bytes(ids(x)).decode() for x in coder.encode(texts)] == texts


def test_cycles_are_not_searched_while_texts_are_encoded():
    searched = []
    coder = units.UnitCoder(lambda texts: searched.append(gc.isenabled()) or [list(t.encode()) for t in texts], limit=5)
    was = gc.isenabled()
    gc.enable()
    assert len(list(coder.encode(["a b", "c"]))) == 2 and gc.isenabled() and searched and not any(searched)
    with pytest.raises(ZeroDivisionError):
        list(units.UnitCoder(lambda texts: 1 / 0).encode(["a"]))
    assert gc.isenabled()
    if not was:
        gc.disable()


def test_byte_bpe_remembers_as_many_pieces_as_word_files_do(tiktoken_encoding):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = units.UnitCoder(byte_bpe._coder(path, public_tokenizers.PATTERN).encode_many, byte_bpe._coder(path, public_tokenizers.PATTERN).limit)
    encode, asked = coder.encode_many, []
    coder.encode_many = lambda texts: asked.extend(texts) or encode(texts)
    texts = [" ".join(f"q{i}" for i in range(at, at + 25_000)) for at in range(0, 250_000, 25_000)]
    once = list(coder.encode(texts))
    n = len(asked)
    assert list(coder.encode(texts)) == once and len(asked) <= n + len(texts)


def test_blocks_travel_in_batches():
    """A row batch has many small blocks, and a long block doesn't wait for others."""
    small = token_files.pack_block([1, None], [2, 1], np.array([7, 8, 9], "<u4"))
    large = token_files.pack_block([3], [2_000_000], np.zeros(2_000_000, "<u4"))
    sizes = [len(some) for some in token_files._batches(small * 2_500 + large + small)]
    assert sizes == [1_000, 1_000, 501, 1]
    assert list(token_files._batches(b"")) == []


def test_word_coder_equals_the_library_on_odd_texts():
    texts = fuzz(4_000)
    coder = units.word_coder(public_tokenizers.path("word_bpe_49k.json"))
    assert [ids(x) for x in coder.encode(texts)] == library("word_bpe_49k.json")(texts)


def test_fast_encoder_has_the_ids_of_the_tokenizers_file():
    texts = fuzz(4_000)
    fast, steady = packing._encoders(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    wanted = library("byte_bpe_50k.json")(texts)
    assert [fast(t) for t in texts] == wanted == [steady(t) for t in texts]


def test_perfect_hash_is_minimal_and_knows_strangers():
    numbers = {f"key{i}".encode(): i for i in range(3_000)}
    table = byte_bpe.PerfectHash(numbers)
    assert len(table.keys) == len(numbers) and set(table.keys) == set(numbers)
    assert table.find(list(numbers)).tolist() == list(numbers.values())
    assert (table.find([f"other{i}".encode() for i in range(500)]) == -1).all()


def test_simple8b_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        values = np.array([rng.getrandbits(rng.choice([1, 2, 8, 15, 16, 20, 30, 60, 64])) for _ in range(rng.randint(0, 300))], np.uint64)
        assert (simple8b.unpack(simple8b.pack(values), len(values)) == values).all()
    assert len(simple8b.pack(np.ones(60, np.uint64))) == 1


def test_block_round_trip_with_group_offsets():
    values = np.arange(10_000, dtype="<u4")
    block = token_files.pack_block([None, 5], [1, 9_999], values)
    [(docs, lengths, back)] = token_files.unpack_blocks(block)
    assert docs == [None, 5] and lengths.tolist() == [1, 9_999] and (back == values).all()


def test_byte_bpe_over_a_table(documents, tiktoken_encoding):
    args = documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    out, whole, wanted = byte_bpe.document_digests(*args), byte_bpe.encode_documents(*args), []
    texts = {(r["doc_id"], bytes(r["decoded"]).decode(), tuple(r["ids"])) for r in whole.collect()}
    assert texts == {(d, t, tuple(tiktoken_encoding.encode_ordinary(t))) for d, t in rows_of(documents)}
    for doc_id, text in rows_of(documents):
        tokens = tiktoken_encoding.encode_ordinary(text)
        wanted.append((doc_id, len(tokens), sha256(" ".join(map(str, tokens)).encode()).hexdigest(), sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(wanted, key=str)


def test_token_files_over_a_table(documents):
    rows = token_files.tokenise_to_files(documents, public_tokenizers.path("word_bpe_49k.json"), 1).collect()
    source = rows_of(documents)
    encoded = [(d, [*x, 1]) for (d, _), x in zip(source, library("word_bpe_49k.json")([t for _, t in source]))]
    digest = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=str) == sorted(
        ((d, len(x), digest(x)) for d, x in encoded), key=str
    )
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows]).tolist()[:-1]]
    order = [r["doc_id"] for r in rows]
    assert order == sorted(order, key=lambda d: (d is not None, d))


def check_packing(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_over_a_table(documents):
    rows = packing.pack_documents(documents, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    n = check_packing(rows, 1024)
    assert n <= -(-sum(r["length"] for r in rows) // 1024) + 1  # the bound below which no packing can be
    wanted = []
    source = rows_of(documents)
    for (doc_id, _), tokens in zip(source, library("byte_bpe_50k.json")([t for _, t in source])):
        tokens = [*tokens, 2]
        for piece, (start, length) in enumerate(packing.cut(len(tokens), 1024)):
            part = np.array(tokens[start : start + length], "<u4").tobytes()
            wanted.append((doc_id, piece, start, length, zlib.crc32(part)))
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_packing_merges_leftovers_of_many_partitions(spark):
    # Few pieces in each of many partitions: most sequences fill up only across levels.  30 is the least possible;
    # three short pieces that meet in one partition may already have cost one more.
    rows = [(i, 700 if i % 2 else 300) for i in range(60)]
    pieces = spark.createDataFrame(rows, "doc_id long, length long").repartition(30)
    assert check_packing(packing.pack(pieces, 1000).collect(), 1000) <= 31
    assert check_packing(packing.pack(pieces.limit(0), 1000).collect(), 1000) == 0


def test_cut_whole_sequences_after_a_shorter_piece():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


@pytest.mark.parametrize("name", ["op2_packing", "op5_byte_bpe", "op6_token_files"])
def test_queries_cover_every_document(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert queries.QUERIES[name](spark, FOLDER).select("doc_id").distinct().count() == docs.count()

"""Token ids in binary files, Simple-8b coded, in ascending order of document.

The documents are range-partitioned and sorted by id (then by a hash of the
text, which orders repeated ids and spreads null ones), encoded where they
arrive, and each partition is written as one file through Spark's writer, so
any store that Spark reaches will do.  A file is a row of blocks:

    "TOK8", docs, ids, words (u32 each)       header
    has_id u8 x docs, doc_id i64 x docs, ids of each doc u32 x docs
    offset of each group of 4096 ids, in words, u32
    Simple-8b words u64, each group starting on a word of its own
    newline

Groups start on word borders, so a reader may decode any of them by its offset.
A block closes after about 64 documents or 65,536 ids; a longer document has a
block to itself.

Null text counts as empty: a document of just the end id.  Null ids come first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import ship, text_of
from palisade.llm.simple8b import pack_groups, unpack
from palisade.llm.units import word_coder
from palisade.session import materialise, scratch_path

_MAGIC = b"TOK8"
GROUP = 4096
_BLOCK_DOCS, _BLOCK_IDS = 64, 65_536
#: Bytes of blocks, and documents of read blocks or bytes of their ids, that make a batch of rows.
_WRITE_BYTES, _READ_DOCS, _READ_BYTES = 1 << 21, 2_000, 1 << 22


def pack_block(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    words, offsets = pack_groups(ids, GROUP)
    return b"".join(
        [
            _MAGIC,
            struct.pack("<3I", len(doc_ids), len(ids), len(words)),
            bytes(d is not None for d in doc_ids),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array(lengths, "<u4").tobytes(),
            offsets.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            b"\n",
        ]
    )


def unpack_blocks(data: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, ids of each doc, all ids) of each block of a file."""
    at = 0
    while at < len(data):
        if data[at : at + 4] != _MAGIC:
            raise ValueError(f"no block at byte {at}")
        n_docs, n_ids, n_words = struct.unpack_from("<3I", data, at + 4)
        at += 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        known, doc_ids, lengths = take("u1", n_docs), take("<i8", n_docs), take("<u4", n_docs)
        offsets = take("<u4", -(-n_ids // GROUP)).tolist()
        words = take("<u8", n_words)
        at += 1
        ids = [
            unpack(words[start:stop], min(GROUP, n_ids - k * GROUP))
            for k, (start, stop) in enumerate(zip(offsets, [*offsets[1:], n_words]))
        ]
        yield (
            [d if k else None for d, k in zip(doc_ids.tolist(), known)],
            lengths,
            np.concatenate(ids).astype("<u4") if ids else np.empty(0, "<u4"),
        )


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all documents and write them to ``folder``."""
    ship(docs)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("doc_id", text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, end = word_coder(tokenizer), np.array([end_id], "<u4").tobytes()
        doc_ids, lengths, parts, n = [], [], [], 0
        ready: list[bytes] = []

        def closed() -> bytes:
            return pack_block(doc_ids, lengths, np.frombuffer(b"".join(parts), "<u4"))

        for batch in batches:
            known, own = batch["doc_id"].notna().tolist(), batch["doc_id"].tolist()
            for i, ids in enumerate(coder.encode(batch["text"])):
                doc_ids.append(int(own[i]) if known[i] else None)
                parts.append(ids + end)
                lengths.append(len(ids) // 4 + 1)
                n += lengths[-1]
                if n >= _BLOCK_IDS or len(doc_ids) >= _BLOCK_DOCS:
                    ready.append(closed())
                    doc_ids, lengths, parts, n = [], [], [], 0
                    if sum(map(len, ready)) >= _WRITE_BYTES:
                        yield pd.DataFrame({"value": ready})
                        ready = []
        if doc_ids:
            ready.append(closed())
        if ready:
            yield pd.DataFrame({"value": ready})

    # A block ends with a newline of its own: the writer's separator.
    packed = rows.mapInPandas(blocks, "value binary").select(
        F.substring("value", F.lit(1), F.octet_length("value") - 1).cast("string").alias("value")
    )
    packed.write.option("lineSep", "\n").text(folder)


def _documents(content: bytes) -> Iterator[tuple[list, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(doc ids, places in the file, number of ids of each doc, their ids) of each block of a file."""
    place = 0
    for doc_ids, lengths, ids in unpack_blocks(content):
        ends = np.cumsum(lengths, dtype=np.int64)
        each = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]
        yield doc_ids, place + ends - lengths, lengths, each
        place += int(ends[-1]) if len(ends) else 0


def _batches(content: bytes) -> Iterator[list[tuple]]:
    """The blocks of a file, some at a time, as ``_documents`` gives them."""
    some, docs, size = [], 0, 0
    for block in _documents(content):
        some.append(block)
        docs += len(block[0])
        size += sum(ids.nbytes for ids in block[3])
        if docs >= _READ_DOCS or size >= _READ_BYTES:
            yield some
            some, docs, size = [], 0, 0
    if some:
        yield some


def _read(spark: SparkSession, folder: str, make, schema: str) -> DataFrame:
    """(file, place in the file, doc_id, columns that ``make`` gives for some blocks) of all documents."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for some in _batches(content):
                    doc_ids, places, lengths, each = zip(*some)
                    known = {"file": path, "place": np.concatenate(places), "doc_id": pd.array([*chain(*doc_ids)], "Int64")}
                    yield pd.DataFrame(known | make(np.concatenate(lengths), [*chain(*each)]))

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInPandas(rows, f"file string, place long, doc_id long, {schema}")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, place in the file, doc_id, ids) of all documents."""
    return _read(spark, folder, lambda lengths, each: {"ids": [ids.astype(np.int32) for ids in each]}, "ids array<int>")


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of the ids of each document, read from the files.

    The checksums are taken where the files are decoded, so that no ids travel.
    """

    def digest(lengths: np.ndarray, each: list[np.ndarray]) -> dict:
        return {"n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(ids.tobytes()) for ids in each]}

    rows = materialise(_read(spark, folder, digest, "n_tokens long, ids_crc32 long"), "token_rows")
    # One row per file: files are as many as partitions, not as documents.
    files = rows.groupBy("file").agg(F.min("doc_id").alias("least"), F.sum("n_tokens").alias("n"))
    before = Window.orderBy(F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(files, "file").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def tokenise_to_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_token_files(docs, folder, tokenizer, end_id)
    return token_digests(spark, folder)

"""Byte-level BPE in two tiers, and decoding.

Tier one resolves pre-tokens that are vocabulary entries as they stand, by a
minimal perfect hash over the vocabulary: two array reads and one comparison,
done for all new pre-tokens of a text at once.  Tier two merges the bytes of
the others, kept as a linked list, by taking the lowest-ranked pair off a heap,
so that a pre-token of n bytes costs n log n whatever its length.

Null text counts as empty and has no ids.  Rows map to rows; nothing moves.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ship, text_of
from palisade.llm.units import UnitCoder


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash of byte strings to their numbers.

    Keys are thrown into buckets by one half of their hash; buckets, the
    largest first, each get the first displacement that puts all their keys on
    free slots of a table with as many slots as keys.
    """

    def __init__(self, numbers: dict[bytes, int]):
        keys = list(numbers)
        n = self.n = max(1, len(keys))
        self.n_buckets = max(1, n // 3)
        self.displacement = np.zeros(self.n_buckets, np.uint64)
        self.keys = np.empty(n, object)
        self.numbers = np.full(n, -1, np.int64)
        hashes = self.hash(keys).tolist()
        buckets: dict[int, list[int]] = {}
        for key, h in enumerate(hashes):
            buckets.setdefault(h % self.n_buckets, []).append(key)
        taken = bytearray(n)
        crowded = sorted((b for b in buckets.items() if len(b[1]) > 1), key=lambda b: -len(b[1]))
        for bucket, group in crowded:
            d = 0
            while True:
                slots = {self.slot(hashes[key], d) for key in group}
                if len(slots) == len(group) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.displacement[bucket] = d
            for key in group:
                self._put(taken, self.slot(hashes[key], d), keys[key], numbers)
        # A key alone in its bucket takes any slot that is left: its displacement names it.
        free = (s for s in range(n) if not taken[s])
        for bucket, group in buckets.items():
            if len(group) == 1:
                slot = next(free)
                self.displacement[bucket] = (1 << 63) | slot
                self.keys[slot], self.numbers[slot] = keys[group[0]], numbers[keys[group[0]]]

    def _put(self, taken: bytearray, slot: int, key: bytes, numbers: dict[bytes, int]) -> None:
        taken[slot] = 1
        self.keys[slot], self.numbers[slot] = key, numbers[key]

    def slot(self, h: int, d: int) -> int:
        mixed = ((h ^ (d * 0x9E3779B97F4A7C15 & _MASK)) * 0xC2B2AE3D27D4EB4F) & _MASK
        return (mixed ^ (mixed >> 29)) % self.n

    @staticmethod
    def hash(keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def slots(self, hashes: np.ndarray, displacement: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (displacement * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        slots = (mixed ^ (mixed >> np.uint64(29))) % np.uint64(self.n)
        return np.where(displacement >> np.uint64(63), displacement & np.uint64(_MASK >> 1), slots)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key, -1 for strangers."""
        hashes = self.hash(keys)
        slots = self.slots(hashes, self.displacement[hashes % np.uint64(self.n_buckets)])
        found = self.numbers[slots]
        there = np.fromiter((a == b for a, b in zip(self.keys[slots], keys)), bool, len(keys))
        return np.where(there, found, -1)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: lowest rank first, leftmost of equals."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: no longer a start
    before = list(range(-1, n))
    rank_of = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank_of(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has been merged since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank_of(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        left = before[i]
        if left >= 0 and (r := rank_of(piece[left:stop])) is not None:
            heapq.heappush(heap, (r, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class TwoTierEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = 200_000):
        import regex

        self.ranks, self.whole, self.split = ranks, PerfectHash(ranks), regex.compile(pattern).findall
        self.merged: dict[bytes, list[int]] = {}
        self.limit = limit

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        split = [[token.encode() for token in self.split(text)] for text in texts]
        tokens = list({token for one in split for token in one})
        ids = {}
        for token, number in zip(tokens, self.whole.find(tokens).tolist()):
            ids[token] = [number] if number >= 0 else self._merged(token)
        return [sum([ids[token] for token in one], []) if len(one) < 4 else [i for token in one for i in ids[token]] for one in split]

    def _merged(self, token: bytes) -> list[int]:
        found = self.merged.get(token)
        if found is None:
            if len(self.merged) >= self.limit:
                self.merged.clear()
            found = merge(token, self.ranks)
            if len(token) <= 64:  # longer ones hardly come again
                self.merged[token] = found
        return found


@lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> UnitCoder:
    return UnitCoder(TwoTierEncoder(read_ranks(path), pattern).encode_many)


@lru_cache(maxsize=2)
def _decoder(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(column: Column, path: str, pattern: str) -> Column:
    """array<int> of ids."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(path, pattern)
        for texts in batches:
            yield pd.Series([np.frombuffer(ids, np.int32) for ids in coder.encode(texts)], dtype=object)

    return ids(column)


def coded(column: Column, path: str, pattern: str) -> Column:
    """struct of the ids of a text and of the bytes that they decode to, in one Python worker."""

    @F.pandas_udf("ids array<int>, decoded binary")
    def both_ways(texts: pd.Series) -> pd.DataFrame:
        coder, table = _coder(path, pattern), _decoder(path)
        ids = [np.frombuffer(one, np.int32) for one in coder.encode(texts)]
        decoded = [b"".join([table[i] for i in one.tolist()]) for one in ids]
        return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(decoded, dtype=object)})

    return both_ways(column)


def decode(column: Column, path: str) -> Column:
    """The bytes that ids stand for; null for null."""

    @F.pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = _decoder(path)
        for rows in batches:
            yield pd.Series([None if ids is None else b"".join([table[i] for i in ids.tolist()]) for ids in rows], dtype=object)

    return data(column)


def digest(both: Column) -> Column:
    """Of a ``coded`` struct: number of ids, and SHA-256 of the ids as text and of the decoded bytes.

    Spark runs this on the struct in the worker that made it, so ids and bytes
    never leave it.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(rows: pd.DataFrame) -> pd.DataFrame:
        def sha(data: bytes) -> str:
            return hashlib.sha256(data).hexdigest()

        names: dict[int, bytes] = {}
        out = []
        for ids, decoded in zip(rows["ids"], rows["decoded"]):
            ids = ids.tolist()
            names.update((i, b"%d" % i) for i in set(ids).difference(names))
            out.append((len(ids), sha(b" ".join([names[i] for i in ids])), sha(decoded)))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(both)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return rows.select("doc_id", text_of().alias("text"))


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and decoded bytes of every document."""
    rows = _documents(docs, id_col, text_col).select("doc_id", coded(F.col("text"), path, pattern).alias("coded"))
    return rows.select("doc_id", "coded.ids", "coded.decoded")


def document_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the digests of every document's ids and decoded bytes."""
    both = coded(F.col("text"), path, pattern)
    rows = _documents(docs, id_col, text_col).select("doc_id", digest(both).alias("digest"))
    return rows.select("doc_id", "digest.*")

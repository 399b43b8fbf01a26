"""Best-fit packing of documents into fixed-length sequences, by levels.

Every partition packs its own pieces best-fit, longest first, and finishes the
bins that are nearly full.  The bins that are not become items themselves:
eight partitions' leftovers meet in one group, are packed best-fit again, and
so on until one group is left.  Only leftovers move, as (bin, fill) rows.

After best-fit a group has at most one bin that is half full or less (two would
have been joined), so all others can only ever take one of the few small bins
of other groups.  A group therefore hands up at most ``MAX_UP`` bins, those with
the most room, and finishes the others as they are: this bounds what meets in
a task and costs next to nothing; no piece is ever dropped.

A document is its ids and an end id.  Only documents longer than a sequence are
cut, into whole sequences after a first piece that may be shorter.  Null text
counts as empty, which is a document of the end id alone.  Repeated rows are
packed as often as they occur.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import ship, text_of
from palisade.session import materialise

#: A bin with less room than this is finished.
NEARLY_FULL = 4
MAX_UP = 4096
FAN_IN = 8
#: A text with a run of this many characters other than space goes to the encoder whose time is not quadratic in it.
_LONG_RUN = 2_000


@lru_cache(maxsize=2)
def _encoders(path: str, pattern: str):
    """The tokenizers file as two encoders of equal ids: ordinary texts, and texts with very long words.

    The first is tiktoken over the vocabulary of the file, several times faster.
    """
    import os

    import tiktoken
    from tokenizers import Tokenizer

    from palisade.llm.units import _BYTE_CHARS

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    byte = {c: b for b, c in _BYTE_CHARS.items()}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items()}
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return fast.encode_ordinary, lambda text: library.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((at, capacity) for at in range(first, n, capacity))]


def tokenised_pieces(
    docs: DataFrame, tokenizer: str, pattern: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, piece, start, length, CRC-32 and ids (as 32-bit words) of every piece."""
    ship(docs)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fast, steady = _encoders(tokenizer, pattern)
        for batch in batches:
            out = []
            doc_ids = batch["doc_id"].astype("Int64")
            for i, text in enumerate(batch["text"]):
                long_run = len(text) > _LONG_RUN and max(map(len, text.split(" "))) > _LONG_RUN
                ids = np.array([*(steady if long_run else fast)(text), end_id], "<u4").tobytes()
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((i, piece, start, length, zlib.crc32(part), part))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])
            frame["doc_id"] = doc_ids.iloc[frame["doc_id"]].array
            yield frame

    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(first item of its bin, place in the bin) of each item: longest first, each to the fullest bin that takes it."""
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin with room r is open
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        fits = open_rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bins[i] = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, bins[i] = capacity, i
        offsets[i] = capacity - room
        if room > size:
            rooms[room - size].append(bins[i])
            open_rooms |= 1 << (room - size)
    return bins, offsets


def _packed(names: np.ndarray, sizes: np.ndarray, capacity: int, last: bool) -> pd.DataFrame:
    """Pack named items; a bin has the name of its first.  ``up``: the bin goes on to the next level."""
    bins, offsets = best_fit(sizes.tolist(), capacity)
    bins = np.array(bins, np.int64)
    fill = np.zeros(len(names), np.int64)
    np.add.at(fill, bins, sizes)
    up = np.zeros(len(names), bool)
    if not last:
        heads = np.flatnonzero((fill > 0) & (fill <= capacity - NEARLY_FULL))
        up[heads[np.argsort(fill[heads], kind="stable")[:MAX_UP]]] = True
    return pd.DataFrame({"item": names, "bin": names[bins], "offset": offsets, "fill": fill[bins], "up": up[bins]})


def _merger(capacity: int, last: bool):
    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        return _packed(group["bin"].to_numpy(), group["fill"].to_numpy(), capacity, last).assign(part=key[0])

    return merge


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces, by their ``length``.

    ``pieces`` must be a stored table: it is read twice.
    """
    ship(pieces)
    columns = pieces.columns
    numbered = materialise(pieces.select("*", F.monotonically_increasing_id().alias("_item")), "pieces")
    schema = "item long, bin long, offset long, fill long, up boolean, part long"

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        rows = [b for b in batches if len(b)]
        if rows:
            every = pd.concat(rows)
            yield _packed(every["_item"].to_numpy(), every["length"].to_numpy(), capacity, False).assign(
                part=TaskContext.get().partitionId()
            )

    first = materialise(numbered.select("_item", "length").mapInPandas(local, schema), "level")
    level, levels = first, []
    n_parts = (first.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        last = n_parts <= FAN_IN
        merge = _merger(capacity, last)
        bins = level.filter("up and item = bin").select("bin", "fill", F.expr(f"part div {FAN_IN}").alias("part"))
        level = materialise(bins.groupBy("part").applyInPandas(merge, schema), "level")
        levels.append(level)
        n_parts = -(-n_parts // FAN_IN)
        if last:
            break
    # Where each leftover bin of the first level ended up; later levels are much smaller.
    ends = levels[0].select("item", F.col("bin").alias("sequence_id"), F.col("offset").alias("shift"))
    for later in levels[1:]:
        moved = later.select(F.col("item").alias("sequence_id"), F.col("bin").alias("_bin"), F.col("offset").alias("_more"))
        ends = ends.join(moved, "sequence_id", "left").select(
            "item",
            F.coalesce("_bin", "sequence_id").alias("sequence_id"),
            (F.col("shift") + F.coalesce("_more", F.lit(0))).alias("shift"),
        )
    ends = ends.withColumnRenamed("item", "bin")
    placed = first.select(F.col("item").alias("_item"), "bin", "offset").join(ends, "bin", "left")
    placed = placed.select(
        "_item",
        F.coalesce("sequence_id", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    return numbered.join(placed, "_item").select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2, capacity: int = 1024, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack documents; one row per piece, with its ids if asked for."""
    pieces = tokenised_pieces(docs, tokenizer, pattern, end_id, capacity)
    return pack(pieces if with_ids else pieces.drop("ids"), capacity)

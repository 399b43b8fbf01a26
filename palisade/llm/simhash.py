"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints that differ in at most three of 64 bits agree on at least one of
four 16-bit segments.  Each distinct fingerprint is rotated so that each segment
in turn leads, and the rotations are sorted by Gray rank across the cluster:
range partitions are even whatever the groups, since distinct fingerprints have
distinct ranks.  Runs with one leading segment are cut into cells of at most
4096, each cell an index (``gray_index``) joined with itself where it lies.
Only runs that take more than one cell need pairs of cells: those whose common
bits already differ too much are dropped in the join, and the others searched
one pair at a time, so no group is ever gathered, whatever its size.

What leaves a task is a spanning forest of the links it found, never all pairs:
between two cells one link for each pair of their components.  Components are
then found by stars (``components``), over fingerprints rather than documents.

Null texts, empty ones and those of white space have no words and fingerprint
zero, and are linked like any other.  Rows of equal text share a fingerprint.
A null doc_id never names a component unless all of its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import FILE, ROW, keep_rows, row_keyed, ship, text_of
from palisade.llm.components import components
from palisade.llm.gray_index import CELL, build, gray_rank, roots, search
from palisade.session import materialise

SHINGLE_WORDS = 3
RADIUS = 3
SEGMENTS = 4
SEED = 42
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 16
#: Runs of up to this many are compared member by member; they would be a single node.
_LEAF = 16


def shingle_hashes(text: bytes, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of a text's word shingles, repeats included, ASCII letters lower-cased."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero without any."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of word shingles."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (as a signed long) and place of each row."""
    ship(docs)

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            codes = np.fromiter((fingerprint(t.encode(), width) for t in texts), np.uint64, len(texts))
            yield pd.Series(codes.view(np.int64))

    rows = row_keyed(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), FILE, ROW)
    return rows.select("doc_id", simhash(text_of()).alias("fp"), FILE, ROW)


def _rotations(codes: DataFrame) -> DataFrame:
    """Each code with each of its segments leading, and the rank of that in Gray order."""
    turned = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(s).alias("seg"),
                    F.shiftleft("fp", 16 * s).bitwiseOR(F.shiftrightunsigned("fp", 64 - 16 * s) if s else F.lit(0)).alias("code"),
                )
                for s in range(SEGMENTS)
            ]
        )
    )
    rows = codes.select(turned.alias("r")).select("r.seg", "r.code")
    rank: Column = F.col("code")
    for shift in (1, 2, 4, 8, 16, 32):
        rows = rows.withColumn("rank", rank.bitwiseXOR(F.shiftrightunsigned(rank, shift)))
        rank = F.col("rank")
    # Signed order of the flipped sign bit is unsigned order.
    return rows.select("seg", "code", rank.bitwiseXOR(F.lit(-(1 << 63))).alias("rank"))


def _unturn(codes: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """The fingerprints of rotations."""
    shift = (16 * seg).astype(np.uint64)
    return np.where(shift == 0, codes, (codes >> shift) | (codes << (np.uint64(64) - np.maximum(shift, np.uint64(1)))))


def _forest(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Links to the smallest fingerprint of each component of the links given."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    top = nodes[roots(len(nodes), place[: len(a)], place[len(a) :])] if len(nodes) else nodes
    apart = nodes != top
    return pd.DataFrame({"a": nodes[apart].view(np.int64), "b": top[apart].view(np.int64)})


_CELLS = "a long, b long, seg int, lead int, cell long, pattern long, mask long, codes binary, labels binary"


def _cells(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links inside the cells of a sorted partition, and the cells of runs that may go on in others."""
        from pyspark import TaskContext

        parts = [b for b in batches if len(b)]
        if not parts:
            return
        seg = np.concatenate([b["seg"].to_numpy() for b in parts]).astype(np.int64)
        codes = np.concatenate([b["code"].to_numpy() for b in parts]).view(np.uint64)
        lead = seg << 16 | (codes >> np.uint64(48)).astype(np.int64)
        heads = np.append(np.flatnonzero(np.diff(lead, prepend=-1)), len(codes))
        fps = _unturn(codes, seg)
        run = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
        size = np.diff(heads)
        links = []
        small = np.flatnonzero(size[run] <= _LEAF)
        for step in range(1, _LEAF):
            i = small[small + step < len(codes)]
            i = i[run[i] == run[i + step]]
            i = i[np.bitwise_count(codes[i] ^ codes[i + step]) <= RADIUS]
            links.append((fps[i], fps[i + step]))
        cells, base = [], TaskContext.get().partitionId() << 32
        edge = {0, len(heads) - 2}
        for r in sorted({*np.flatnonzero(size > _LEAF).tolist(), *edge}):
            start, stop = int(heads[r]), int(heads[r + 1])
            for at in range(start, stop, limit):
                own = codes[at : min(at + limit, stop)]
                index = build(own)
                i, j = search(index, index, RADIUS, same=True)
                links.append((fps[at + i], fps[at + j]))
                if r in edge or stop - start > limit:
                    label = roots(len(own), i, j).astype("<u2")
                    cells.append((int(seg[at]), int(lead[at] & 0xFFFF), base + at, *[int(x[0].view(np.int64)) for x in index[3]], own.tobytes(), label.tobytes()))
        found = _forest(np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))
        if len(found):
            yield found.assign(seg=None, lead=None, cell=None, pattern=None, mask=None, codes=None, labels=None)
        if cells:
            yield pd.DataFrame(cells, columns=["seg", "lead", "cell", "pattern", "mask", "codes", "labels"]).assign(a=None, b=None)[_CELLS.replace(",", "").split()[::2]]

    return run


def _between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between the two cells of each row: one for each pair of their components."""
    for batch in batches:
        links = []
        for r in batch.itertuples(index=False):
            one, two = np.frombuffer(r.codes, np.uint64), np.frombuffer(r.codes2, np.uint64)
            i, j = search(build(one), build(two), RADIUS, same=False)
            pairs = np.unique(np.frombuffer(r.labels, "<u2")[i].astype(np.int64) << 16 | np.frombuffer(r.labels2, "<u2")[j])
            turned = np.full(len(pairs), r.seg)
            links.append((_unturn(one[pairs >> 16], turned), _unturn(two[pairs & 0xFFFF], turned)))
        yield _forest(np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links]))


def links(codes: DataFrame, cell: int = CELL) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``fp`` at most ``RADIUS`` apart."""
    ship(codes)
    rows = _rotations(codes).repartitionByRange("seg", "rank").sortWithinPartitions("seg", "rank").select("seg", "code")
    made = materialise(rows.mapInPandas(_cells(cell), _CELLS), "cells")
    cells = made.filter("cell is not null").drop("a", "b")
    other = cells.select("seg", "lead", *[F.col(c).alias(f"{c}2") for c in ("cell", "pattern", "mask", "codes", "labels")])
    apart = F.bit_count(F.col("pattern").bitwiseXOR(F.col("pattern2")).bitwiseAND(F.col("mask")).bitwiseAND(F.col("mask2")))
    pairs = cells.join(other, ["seg", "lead"]).filter((F.col("cell") < F.col("cell2")) & (apart <= RADIUS))
    pairs = pairs.select("seg", "codes", "labels", "codes2", "labels2")
    return made.filter("a is not null").select("a", "b").unionByName(pairs.mapInPandas(_between, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint in hex, component_id, and whether the row is the first of its component."""
    rows = materialise(fingerprints(docs, width, id_col, text_col), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)
    codes = materialise(rows.groupBy("fp").agg(F.min(order).alias("first")), "codes")
    tops = components(links(codes.select("fp")))
    rooted = codes.join(tops.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = materialise(rooted.select("fp", "root").join(first, "root").select("fp", "first"), "components")
    return rows.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        ((F.col(FILE) == F.col(f"first.{FILE}")) & (F.col(ROW) == F.col(f"first.{ROW}"))).alias("kept"),
        FILE,
        ROW,
    )


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id."""
    keyed = row_keyed(docs)
    return keep_rows(keyed, near_duplicates(keyed, width).filter("kept"))

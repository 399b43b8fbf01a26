"""Near-duplicates by exact Jaccard similarity of five-word shingles.

Two texts are linked if their sets of shingles have a similarity of at least 0.8,
and groups are the components of those links.

*Candidates.*  Fingerprints of the shingles go through the Gray-order index of
``simhash``; the components that it links are the first buckets.  At 0.8 fingerprints
differ in some ten of 64 bits, often in more than sixteen, and segments for such a
radius are too narrow to be an index, so these buckets hold the closest texts only.
Those that share all ``PER_BAND`` minima of one of ``BANDS`` bands are buckets too:
a pair at 0.8 is missed by them with probability 5e-8, one at 0.9 with 1.5e-15.  One
bit of each minimum makes a sketch; pairs whose sketches differ in more than
``SKETCH_BITS`` of 128 bits (2e-9 of those at 0.8) aren't compared.

*Links.*  Every member of a bucket is first compared with its smallest member, which
connects groups of copies without their pairs.  For what then lies in different
components, members are written as their differences from that smallest member R:
the shingles in one of the two sets only.  X and Y differ in as many shingles as
their differences from R do, so the pair has the similarity exactly if at most a
ninth of their summed sizes is in one list of differences only.  Two members that
aren't both linked to R must therefore share a difference, and of those shared the
first one, in an order with the rarest first, must leave enough behind it in both
lists.  That is exact, and for edits of a common text it is the similarity itself:
its members at less than 0.8 never meet.  Members that share a difference in such
places are compared with the one that has it earliest, then those that are still in
different components with each other.  A pair counts by the exact similarity of the
two sets, never by an estimate.

Texts with fewer than five words are one shingle.  Null texts, empty ones and those
of white space have no shingle, and are equal.  Sets are known by a 64-bit hash,
shingles by another.  Of a group the row with the smallest doc_id stays; a null
doc_id only if all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from palisade.llm import simhash
from palisade.llm.common import FILE, ROW, keep_rows, row_keyed, ship, text_of
from palisade.llm.components import components
from palisade.session import materialise

WIDTH = 5
#: The similarity as a fraction, so that it is compared in whole numbers.
PARTS, WHOLE = 4, 5
BANDS, PER_BAND = 32, 4
SKETCH_BITS = 36
SEED = 42
#: Shingles whose minima are taken at a time.
_CHUNK = 1 << 12
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * PER_BAND).astype(np.uint64) << np.uint64(1) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, ASCII letters lower-cased."""
    return np.unique(simhash.shingle_hashes(text, WIDTH))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest product of the hashes with each factor."""
    least = np.full(len(_FACTORS), ~np.uint64(0))
    for at in range(0, len(hashes), _CHUNK):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + _CHUNK]).min(axis=1), out=least)
    return least


_SKETCHED = "node long, n long, s1 long, s2 long, bands array<long>, fp long"


def _sketch(text: bytes) -> tuple:
    import xxhash

    every = simhash.shingle_hashes(text, WIDTH)
    own = np.unique(every)
    least = minima(own)
    # Low bits of a product by an odd factor are those of the hash: take a mixed one.
    bits = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), k) & 1 for k, x in enumerate(least)), np.uint8, len(least))
    s1, s2 = np.packbits(bits).view("<i8").tolist()
    keys = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, PER_BAND))), np.uint64, BANDS)
    node = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)
    fp = np.uint64(simhash.majority(every)).view(np.int64)
    return int(node), len(own), s1, s2, keys.view(np.int64), int(fp)


def _sketched(docs: DataFrame) -> DataFrame:
    """doc_id and place of each row; the hash, size, sketch and bands of its set, and its fingerprint."""

    @F.pandas_udf(_SKETCHED)
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([_sketch(t.encode()) for t in texts], columns=["node", "n", "s1", "s2", "bands", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), FILE, ROW, sketch(text_of()).alias("s"))
    return rows.select("doc_id", FILE, ROW, "s.*")


def _may_link(a: str, b: str) -> Column:
    """Whether two sets may have the similarity, by their sizes and sketches."""
    at = lambda c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    apart = sum((F.bit_count(x.bitwiseXOR(y)) for x, y in (at("s1"), at("s2"))), F.lit(0))
    return (F.least(*at("n")) * WHOLE >= F.greatest(*at("n")) * PARTS) & (apart <= SKETCH_BITS)


@F.pandas_udf(LongType())
def _common(one: pd.Series, two: pd.Series) -> pd.Series:
    """Number of hashes in both of two sets."""
    sets = lambda x: (np.frombuffer(s, np.uint64) for s in x)
    return pd.Series([len(np.intersect1d(a, b, assume_unique=True)) for a, b in zip(sets(one), sets(two))], dtype="int64")


@F.pandas_udf(BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t.encode()).tobytes() for t in texts], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def _apart(one: pd.Series, two: pd.Series) -> pd.Series:
    """The hashes that only one of two sets has."""
    sets = lambda x: (np.frombuffer(s, np.int64) for s in x)
    return pd.Series([np.setxor1d(a, b, assume_unique=True) for a, b in zip(sets(one), sets(two))], dtype=object)


def _sets(nodes: DataFrame, docs: DataFrame, codes: DataFrame) -> DataFrame:
    """node and packed hashes of the sets in ``nodes``."""
    place = codes.join(nodes, "node", "left_semi").select("node", F.col(f"first.{FILE}").alias(FILE), F.col(f"first.{ROW}").alias(ROW))
    texts = docs.select(FILE, ROW, text_of().alias("_text"))
    return materialise(texts.join(place, [FILE, ROW]).select("node", _packed("_text").alias("set")), "sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with both sets."""
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")), side)
    return pairs


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity."""
    size = F.octet_length("set_a") / 8 + F.octet_length("set_b") / 8
    pairs = _with_sets(pairs, sets).select("a", "b", size.cast("long").alias("size"), _common("set_a", "set_b").alias("common"))
    return materialise(pairs.filter(F.col("common") * WHOLE >= (F.col("size") - F.col("common")) * PARTS).select("a", "b"), "links")


def _fingerprint_groups(rows: DataFrame) -> DataFrame:
    """The sets (``x``) of each component (``key``) of fingerprints that the Gray-order index links."""
    codes = materialise(rows.select("fp").distinct(), "codes")
    tops = components(simhash.links(codes)).withColumnRenamed("node", "fp")
    found = rows.join(tops, "fp", "left").select(F.coalesce("root", "fp").alias("key"), F.struct("node", "n", "s1", "s2").alias("x"))
    return materialise(found, "groups")


def _buckets(rows: DataFrame) -> DataFrame:
    """The smallest set (``rep``) of each bucket with two sets or more, and each set of it (``x``), once for all buckets.

    Components of fingerprints are buckets, and so are equal bands.
    """
    seen = rows.select(F.explode("bands").alias("key"), F.struct("node", "n", "s1", "s2").alias("x"))
    seen = _fingerprint_groups(rows).unionByName(seen)
    reps = seen.groupBy("key").agg(F.min("x").alias("rep"), F.max("x.node").alias("last")).filter("rep.node <> last").drop("last")
    return materialise(seen.join(reps, "key").select("rep", "x").distinct(), "buckets")


def _labelled(rows: DataFrame, tops: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the component of ``x``, of those groups that have several."""
    named = rows.join(tops.select(F.col("node").alias("_node"), "root"), F.col("x.node") == F.col("_node"), "left")
    named = materialise(named.select(*rows.columns, F.coalesce("root", "x.node").alias("label")), "labels")
    open_ = named.groupBy(*by).agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return named.join(open_.select(*by), by, "left_semi")


def _index(members: DataFrame, tops: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, gram, x, number of its differences and place of ``gram`` among them, where a link to another component may start."""
    named = _labelled(members.select(F.col("rep.node").alias("rep"), "x"), tops, ["rep"]).filter("rep <> x.node")
    pairs = _with_sets(named.select(F.col("rep").alias("a"), F.col("x.node").alias("b"), "label"), sets)
    apart = pairs.select(F.col("a").alias("rep"), F.col("b").alias("node"), "label", _apart("set_a", "set_b").alias("apart"))
    apart = apart.select("rep", "node", "label", F.size("apart").alias("size"), F.explode("apart").alias("gram"))
    apart = materialise(apart, "apart")
    held = apart.groupBy("rep", "gram").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("low"), F.max("label").alias("high"))
    # What only one component has comes first in the order, for it starts no link to another.
    kept = apart.drop("label").join(held.filter("low <> high").select("rep", "gram", "held"), ["rep", "gram"])
    own = Window.partitionBy("rep", "node")
    before = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("held", "gram")) - 1
    placed = kept.select("rep", "node", "gram", "size", before.alias("at"))
    sized = members.select(F.col("rep.node").alias("rep"), F.col("x.node").alias("node"), "x")
    # A partner has at most 5/4 of the size, so a quarter of it may be in this list only.
    found = placed.join(sized, ["rep", "node"]).filter(F.col("at") * PARTS <= F.col("x.n"))
    return materialise(found.select("rep", "gram", "x", "size", "at"), "index")


def _reaches(a: str, b: str) -> Column:
    """Whether enough is left in both lists of differences, if the shared one is the first."""
    n = F.col(f"{a}.x.n") + F.col(f"{b}.x.n")
    left = F.least(F.col(f"{a}.size") - F.col(f"{a}.at"), F.col(f"{b}.size") - F.col(f"{b}.at"))
    return (F.col(f"{a}.size") + F.col(f"{b}.size") - 2 * left) * (PARTS + WHOLE) <= n * (WHOLE - PARTS)


def _met(rows: DataFrame) -> DataFrame:
    """The distinct pairs of sets of rows ``p`` and ``q`` that may be linked."""
    rows = rows.filter((F.col("p.label") != F.col("q.label")) & _reaches("p", "q") & _may_link("p.x", "q.x"))
    nodes = F.col("p.x.node"), F.col("q.x.node")
    return rows.select(F.least(*nodes).alias("a"), F.greatest(*nodes).alias("b")).distinct()


def _sharing(index: DataFrame, tops: DataFrame) -> DataFrame:
    """rep, gram and the row (``p``) of each set in another component than some set with the same difference."""
    rows = _labelled(index, tops, ["rep", "gram"])
    return materialise(rows.select("rep", "gram", F.struct("x", "size", "at", "label").alias("p")), "sharing")


def _with_earliest(sharing: DataFrame) -> DataFrame:
    """Pairs of each set with the one that has their shared difference earliest."""
    first = sharing.groupBy("rep", "gram").agg(F.min_by("p", F.struct("p.at", "p.x.node")).alias("q"))
    return materialise(_met(sharing.join(first, ["rep", "gram"])), "pairs")


def _with_others(sharing: DataFrame) -> DataFrame:
    """All pairs of sets in different components that share a difference."""
    # Of two such sets at least one isn't in the group's largest component.
    sizes = sharing.groupBy("rep", "gram", "p.label").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("rep", "gram").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    rest = sharing.join(most, ["rep", "gram"]).filter(F.col("p.label") != F.col("most")).drop("most")
    return _met(rest.join(sharing.withColumnRenamed("p", "q"), ["rep", "gram"]))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id and place of each row of ``docs`` (from ``row_keyed``), and whether it is the first of its group."""
    ship(docs)
    rows = materialise(_sketched(docs), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, ROW)
    codes = materialise(rows.groupBy("node").agg(F.min(order).alias("first")), "codes")
    members = _buckets(rows)
    sets = _sets(members.select(F.col("x.node").alias("node")).distinct(), docs, codes)
    stars = members.filter((F.col("x.node") != F.col("rep.node")) & _may_link("x", "rep"))
    found = _verified(stars.select(F.col("rep.node").alias("a"), F.col("x.node").alias("b")), sets)
    tops = components(found)

    index = _index(members, tops, sets)
    pairs = _with_earliest(_sharing(index, tops))
    if not pairs.isEmpty():
        tops = _extended(tops, _verified(pairs, sets))
    rest = materialise(_with_others(_sharing(index, tops)).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        tops = _extended(tops, _verified(rest, sets))

    rooted = codes.join(tops, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    firsts = rooted.select("node", "root").join(first, "root").select("node", "first")
    kept = (F.col(FILE) == F.col(f"first.{FILE}")) & (F.col(ROW) == F.col(f"first.{ROW}"))
    return rows.join(firsts, "node").select("doc_id", F.col("first.doc_id").alias("component_id"), kept.alias("kept"), FILE, ROW)


def _extended(tops: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return components(tops.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns."""
    keyed = row_keyed(docs)
    return keep_rows(keyed, near_groups(keyed).filter("kept"))

"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks.  The distinct blocks are sorted and
numbered, so that two blocks have one name exactly when they are equal; then
adjacent names are paired, and the distinct pairs sorted and numbered in turn,
until each document has a single name.  Number of blocks and last name together
are its identity: two documents share it exactly when their texts are equal.

Block contents cross the network once, as distinct blocks and after map-side
aggregation, so copies of one block cost a row per task.  Documents are then
given their blocks' names by joining on a 128-bit digest; should two different
blocks share a digest, those blocks are found in the table of names and joined
by content instead, so names never rest on a digest being unique.  All joins
are ordinary ones that adaptive execution splits for hot groups.

Null text counts as empty.  Of equal texts the row with the largest doc_id
stays (null is smallest); among rows repeating that id too, the last one of the
last file.  Every input row gives one output row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import FILE, ROW, keep_rows, row_keyed, text_of
from palisade.session import materialise

#: Bytes of a block.  Most web documents are one or two blocks.
BLOCK_BYTES = 4096


def digest(block: Column) -> list[Column]:
    """128 bits of a block, in two longs."""
    return [F.xxhash64(block).alias("h1"), F.xxhash64(F.lit(1), block, F.lit(2)).alias("h2")]


def _blocks(text: Column, size: int) -> Column:
    data = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(text) / size).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """Sort and number the rows; equal rows must have met in one partition."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _first_names(docs: DataFrame, prep: DataFrame, size: int) -> DataFrame:
    """(id, n, pos, name) of every block."""
    contents = docs.select(F.explode(_blocks(text_of(), size)).alias("block"))
    names = materialise(_named(contents.distinct(), "block").select("name", *digest(F.col("block"))), "block_names")
    places = prep.select("id", "n", F.posexplode("digests").alias("pos", "d")).select("id", "n", "pos", "d.h1", "d.h2")
    clashes = names.groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2")
    if clashes.isEmpty():
        return places.join(names, ["h1", "h2"]).select("id", "n", "pos", "name")
    clashes = materialise(clashes, "clashes")
    clear = places.join(clashes, ["h1", "h2"], "left_anti").join(names, ["h1", "h2"]).select("id", "n", "pos", "name")
    # Blocks whose digest isn't theirs alone: name them anew, and join by content.
    keyed = docs.select(FILE, ROW, F.posexplode(_blocks(text_of(), size)).alias("pos", "block"))
    mixed = keyed.select("*", *digest(F.col("block"))).join(clashes, ["h1", "h2"], "left_semi")
    anew = materialise(_named(mixed.select("block").distinct(), "block").withColumn("name", -1 - F.col("name")), "block_names")
    by_content = mixed.join(anew, "block").join(prep.select("id", "n", FILE, ROW), [FILE, ROW])
    return clear.unionByName(by_content.select("id", "n", "pos", "name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its place, id, SHA-256, number of blocks and name."""
    docs = row_keyed(docs).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), FILE, ROW)
    prep = docs.select(
        F.monotonically_increasing_id().alias("id"),
        "doc_id",
        FILE,
        ROW,
        F.sha2(text_of(), 256).alias("text_sha256"),
        F.transform(_blocks(text_of(), size), lambda b: F.struct(*digest(b))).alias("digests"),
    )
    prep = materialise(prep.withColumn("n", F.size("digests")), "documents")
    level = materialise(_first_names(docs, prep, size), "names")
    width, done = prep.agg(F.max("n")).first()[0] or 1, level.filter("n = 1").select("id", "name")
    while width > 1:
        pairs = (
            level.filter("n > 1")
            .groupBy("id", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.expr("pos div 2").cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                # A block without a partner keeps the place empty.
                F.max(F.when(F.col("pos") % 2 == 1, F.struct("name"))).alias("right"),
            )
            .select("id", "n", "pos", "left", F.col("right.name").isNull().alias("single"), F.coalesce("right.name", F.lit(0)).alias("right"))
        )
        pairs = materialise(pairs, "pairs")
        names = materialise(_named(pairs.select("left", "right", "single").distinct(), "left", "right", "single"), "pair_names")
        level = materialise(pairs.join(names, ["left", "right", "single"]).select("id", "n", "pos", "name"), "names")
        done = done.unionByName(level.filter("n = 1").select("id", "name"))
        width = -(-width // 2)
    return prep.drop("digests").join(done, "id")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Group every document with those of equal text; ``kept`` marks one of each group."""
    rows = materialise(identities(docs, id_col, text_col, size), "identities")
    groups = rows.groupBy("n", "name").agg(
        F.max(F.struct("doc_id", FILE, ROW)).alias("keep"), F.count(F.lit(1)).alias("group_size")
    )
    same = (F.col(FILE) == F.col(f"keep.{FILE}")) & (F.col(ROW) == F.col(f"keep.{ROW}"))
    return rows.join(groups, ["n", "name"]).select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", same.alias("kept"), "text_sha256", FILE, ROW
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    keyed = row_keyed(docs)
    return keep_rows(keyed, exact_duplicates(keyed).filter("kept"))

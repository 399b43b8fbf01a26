"""Connected components of a table of links, by alternating large and small stars.

Each round hooks every node's larger neighbours to its smallest one, and then
its smaller neighbours too; after a number of rounds that is logarithmic in
practice, each component is a star around its smallest node.  A round is two
aggregations for the minimum and two joins, so no node's neighbours ever meet
in one task's memory.  Rounds end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; ``links`` is (a, b) of longs."""
    edges = materialise(links.select("a", "b").filter("a <> b"), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct(), "stars")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialise(small.filter("a <> b").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now

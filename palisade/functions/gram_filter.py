"""A compact membership filter over grams, for leaving out unknown ones before a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one bitmap that the aggregation builds, and bounds of the filter's size: 8 KB to 32 MB.
_BITMAP = 32_768
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
_BITS_PER_GRAM = 16


def filter_bits(n_grams: int) -> int:
    """A power of two for about 1.4 % of false hits, up to the bound; a fuller filter only lets more through."""
    wanted = max(MIN_BITS, min(MAX_BITS, n_grams * _BITS_PER_GRAM))
    return 1 << (wanted - 1).bit_length()


class GramFilter:
    """Tells of most grams outside a set that they are outside, and of none inside.

    Two bits per gram, from the halves of its XXH64 hash, which Spark and the
    workers compute alike.  What it lets through by chance the join drops.
    """

    def __init__(self, bitmap: np.ndarray):
        self.bitmap, self.mask = bitmap, np.uint64(len(bitmap) * 8 - 1)

    @classmethod
    def of(cls, grams: DataFrame, n_grams: int) -> "GramFilter":
        """Built by aggregation from a ``gram`` column; the driver gets the bitmaps, whose size is bounded."""
        bits = filter_bits(n_grams)
        h = F.xxhash64("gram")
        places = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits)))).alias("place")
        rows = grams.select(places).groupBy(F.floor(F.col("place") / _BITMAP).alias("part")).agg(
            F.bitmap_construct_agg(F.col("place") % _BITMAP).alias("bits")
        )
        bitmap = np.zeros(bits // 8, np.uint8)
        for row in rows.toLocalIterator():
            part = np.frombuffer(row["bits"], np.uint8)
            bitmap[row["part"] * (_BITMAP // 8) :][: len(part)] = part
        return cls(bitmap)

    def might_contain(self, grams: list[str]) -> np.ndarray:
        import xxhash

        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(g.encode(), 42) for g in grams), np.uint64, len(grams))
        # An arithmetic shift, as Spark's.
        high = (h.view(np.int64) >> np.int64(32)).view(np.uint64)
        return self._set(h & self.mask) & self._set(high & self.mask)

    def _set(self, place: np.ndarray) -> np.ndarray:
        return (self.bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

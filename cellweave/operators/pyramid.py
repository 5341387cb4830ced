"""Overviews: block sums at every power of two, each made from the one below and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.columns import finite, rounded
from cellweave.sources.tables import written


def _halved(level: DataFrame) -> DataFrame:
    up = lambda c: F.shiftright(F.col(c), 1).alias(c)
    return level.groupBy(up("col"), up("row")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


class Pyramid:
    """Levels of ``(col, row, total, n)``: sum and count of the finite values of blocks of 2^level cells a side."""

    def __init__(self, levels: list[DataFrame], counts: list[int]):
        self.levels, self.counts = levels, counts

    @classmethod
    def build(cls, cells: DataFrame, v: str, least: int = 1) -> Pyramid:
        """All levels up to the first of at most ``least`` blocks. Base cells are read once; each level is written, and the next one reads that."""
        value = F.col(v).cast("double")
        base = cells.where(finite(F.col(v))).groupBy(F.col("col").cast("int").alias("col"), F.col("row").cast("int").alias("row")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
        levels, counts = [written(base, "level-0")], []
        while True:
            counts.append(levels[-1].count())  # of what is written, so from the files' footers
            # blocks at negative and positive places stay apart at every level
            if counts[-1] <= least or len(counts) > 1 and counts[-1] == counts[-2] <= 4:
                return cls(levels, counts)
            levels.append(written(_halved(levels[-1]), f"level-{len(levels)}"))

    def level(self, k: int, v: str = "v") -> DataFrame:
        """``(col, row, v, factor)``: means of the blocks of a level."""
        return self.levels[k].select("col", "row", rounded(F.col("total") / F.col("n")).alias(v), F.lit(1 << k).alias("factor"))

    def within(self, max_pixels: int, v: str = "v") -> DataFrame:
        """The finest level of at most so many blocks; the coarsest one if none is so small."""
        k = next((k for k, n in enumerate(self.counts) if n <= max_pixels), len(self.counts) - 1)
        return self.level(k, v)

"""Mosaics of overlapping tiles, per-cell features over years, and feature cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.columns import rounded, sound
from cellweave.operators.grid import best_tile, sent_if_few
from cellweave.operators.proximity import with_distances

#: which observation of a cell and year lies on top: the one of the greatest tile number
ORDER = "tile_id"
CELL = ["col", "row"]


def _on_top(bands: list[str], order: str | Column | list[str]) -> list[Column]:
    """Of each band the valid value that comes last in the order.

    One column (a number, also a packed one) is a key that a hash aggregate can hold; a list of columns makes
    a struct, which Spark aggregates by sorting.
    """
    key = F.struct(*order) if isinstance(order, (list, tuple)) else F.col(order) if isinstance(order, str) else order
    return [F.max_by(F.col(b), F.when(F.col(b).isNotNull(), key)).alias(b) for b in bands]


def mosaic(pixels: DataFrame, bands: list[str], order: str | Column | list[str] = ORDER) -> DataFrame:
    """One row for each (year, col, row): of every band the valid value that lies on top, else null.

    One aggregation with map-side combining; each band keeps a mask of its own.
    """
    return pixels.groupBy("year", *CELL).agg(*_on_top(bands, order))


def from_best_tile(pixels: DataFrame, best: DataFrame, aois: DataFrame, bands: list[str], order: str | Column | list[str] = ORDER) -> DataFrame:
    """The same from each region's best tile of every year only, ``best(aoi, year, tile_id)``; (aoi, year, col, row)."""
    held = pixels.join(sent_if_few(best.select("aoi", "year", "tile_id"), aois), ["year", "tile_id"])
    return held.groupBy("aoi", "year", *CELL).agg(*_on_top(bands, order))


def mean_std(v: Column) -> list[Column]:
    v = sound(v)
    return [rounded(F.avg(v)).alias("mean"), rounded(F.stddev_pop(v)).alias("std")]


def trend(v: Column) -> Column:
    """Slope by year of the finite values; null for a cell of one year."""
    v = sound(v)
    return rounded(F.regr_slope(v, F.when(v.isNotNull(), F.col("year").cast("double")))).alias("trend")


def at(v: Column, year: int) -> Column:
    return F.max(F.when(F.col("year") == year, sound(v)))


def change(v: Column, first: int, last: int) -> Column:
    """Last year minus first; null where either is."""
    return rounded(at(v, last) - at(v, first)).alias("change")


def thresholds(df: DataFrame, v: str, levels: tuple[float, ...] = (5, 10)) -> DataFrame:
    """Masks v >= level, and their complements; null where v isn't finite."""
    c = sound(F.col(v))
    return df.withColumns({f"ge{int(t)}": c >= t for t in levels} | {f"lt{int(t)}": ~(c >= t) for t in levels})


def change_cube(years: DataFrame, v: str, first: int, last: int, levels: tuple[float, ...] = (5, 10), keys: list[str] = CELL, value: bool = False) -> DataFrame:
    """Mean, deviation, change, trend and threshold masks of the last year, and its ``value`` if asked for: one aggregation over one scan."""
    c = F.col(v)
    held = years.where(F.col("year").between(first, last))
    own = [at(c, last).alias(v)] if value else []
    return held.groupBy(*keys).agg(*own, *mean_std(c), change(c, first, last), trend(c), *[(at(c, last) >= t).cast("int").alias(f"ge{int(t)}") for t in levels])


def feature_cube(pixels: DataFrame, v: str, first: int, last: int, source: str = "mosaic", tiles: DataFrame | None = None, aois: DataFrame | None = None, best: DataFrame | None = None, order: str | Column | list[str] = ORDER) -> DataFrame:
    """The change cube of a band: of all tiles together (``mosaic``), or of each region from its best tile of each
    year alone (``best_tile``), which ``tiles`` and ``aois`` give unless ``best(aoi, year, tile_id)`` does."""
    held = pixels.where(F.col("year").between(first, last))
    if source == "mosaic":
        return change_cube(mosaic(held, [v], order), v, first, last)
    if source != "best_tile":
        raise ValueError(f"source is mosaic or best_tile, not {source}")
    best = best_tile(tiles, aois, by_year=True) if best is None else best
    return change_cube(from_best_tile(held, best, aois, [v], order), v, first, last, keys=["aoi", *CELL])


def prior_cube(years: DataFrame, v: str, first: int, last: int, levels: tuple[float, ...] = (5, 10), radius: int = 255, metres: float = 10.0) -> DataFrame:
    """Cover of the last year, mean, deviation, trend, threshold masks and distances to the nearest cell from each threshold on."""
    c = F.col(v)
    held = years.where(F.col("year").between(first, last))
    cube = held.groupBy(*CELL).agg(rounded(at(c, last)).alias("cover"), *mean_std(c), trend(c), *[(at(c, last) >= t).cast("int").alias(f"ge{int(t)}") for t in levels])
    return with_distances(cube, {f"dist_ge{int(t)}": F.col(f"ge{int(t)}") == 1 for t in levels}, radius, metres)


def dense(cells: DataFrame) -> DataFrame:
    """All cells of the bounding lattice, with the columns of those that exist.

    One task makes the lattice's columns, and as many as shuffles have partitions make their cells.
    """
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    box = cells.agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.min("row").alias("r0"), F.max("row").alias("r1")).where("c0 is not null")
    columns = box.select(F.explode(F.sequence("c0", "c1")).alias("col"), "r0", "r1").repartition(parts, "col")
    return columns.select("col", F.explode(F.sequence("r0", "r1")).alias("row")).join(cells, CELL, "left")


def distance(grid: DataFrame, hit: Column, radius: int = 255, metres: float = 10.0, name: str = "distance") -> DataFrame:
    """``(col, row, name)``: metres from each cell of the grid to its nearest hit within so many cells, null beyond."""
    return with_distances(grid.select(*CELL, hit.alias("hit")), {name: F.col("hit")}, radius, metres).select(*CELL, name)

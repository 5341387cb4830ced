"""Regions, tiles and grids. A cell is (col, row); its centre is (col + 0.5, row + 0.5) in units of the scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.columns import KM_PER_DEGREE, degrees_east, mercator, rounded
from cellweave.operators import vector
from cellweave.operators.prefix import cumulative

#: so many regions are sent to every executor; more are joined by quadtree squares
FEW_REGIONS = 256


def few_regions(aois: DataFrame, few: int = FEW_REGIONS) -> bool:
    """Whether there are so few regions that every executor can have them all."""
    return aois.limit(few + 1).count() <= few


def sent_if_few(df: DataFrame, aois: DataFrame, few: int = FEW_REGIONS) -> DataFrame:
    """A table of some rows for each region: to every executor if regions are few, else Spark decides by size."""
    return F.broadcast(df) if few_regions(aois, few) else df


def zonal_join(cells: DataFrame, aois: DataFrame, scale: float = 1.0, few: int = FEW_REGIONS) -> DataFrame:
    """Cells with each region that holds their centre, in [minx, maxx) x [miny, maxy).

    Few regions go to the executors. Many are covered by quadtree squares (``cover``), and cells meet the squares
    that hold them in an equi-join, one for each level that some region has, so that no cell is compared with
    every region and no region is cut into more than some hundred squares.
    """
    x, y = (F.col("col") + 0.5) * scale, (F.col("row") + 0.5) * scale
    inside = (x >= F.col("minx")) & (x < F.col("maxx")) & (y >= F.col("miny")) & (y < F.col("maxy"))
    if few_regions(aois, few):
        return cells.join(F.broadcast(aois), inside)
    laid = cover(aois, scale)
    # numbers of quadtree levels: some dozens at most
    levels = [r[0] for r in laid.select("level").distinct().collect()]
    held = cells.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))) if levels else cells.withColumn("level", F.lit(0)).limit(0)
    held = held.withColumns({"qx": F.expr("shiftright(cast(col as bigint), level)"), "qy": F.expr("shiftright(cast(row as bigint), level)")})
    return held.join(laid, ["level", "qx", "qy"]).where(inside).drop("level", "qx", "qy")


def cover(aois: DataFrame, scale: float = 1.0, side: int = 64) -> DataFrame:
    """Regions with the quadtree squares that cover them: ``level``, ``qx``, ``qy``, of 2^level cells a side.

    The lowest level is that at which the region is at most ``side`` squares long. Squares of that level that the
    region cuts are kept; what lies inside is covered by the largest squares that fit, so a region of any size has
    fewer than 16 * side squares.
    """
    first, last = lambda c: F.ceil(F.col(c) / scale - 0.5).cast("long"), lambda c: F.ceil(F.col(c) / scale - 0.5).cast("long") - 1
    boxed = aois.withColumns({"x0": first("minx"), "x1": last("maxx"), "y0": first("miny"), "y1": last("maxy")}).where("x0 <= x1 and y0 <= y1")
    base = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("x1") - F.col("x0") + 1, F.col("y1") - F.col("y0") + 1) / side)).cast("int"))
    laid = boxed.withColumn("base", base).withColumn("level", F.explode(F.sequence(F.col("base"), F.col("base") + 7)))
    for axis in "xy":
        laid = laid.withColumn(f"q{axis}", F.explode(F.expr(f"sequence(shiftright({axis}0, level), shiftright({axis}1, level))")))
    within = lambda up: " and ".join(f"shiftleft(shiftright(q{a}, {up}), level + {up}) >= {a}0 and shiftleft(shiftright(q{a}, {up}) + 1, level + {up}) - 1 <= {a}1" for a in "xy")
    kept = laid.where(F.expr(f"({within(0)}) and not (level < base + 7 and {within(1)}) or level = base and not ({within(0)})"))
    return kept.drop("base", "x0", "x1", "y0", "y1")


def zonal_overlap(cells: DataFrame, aois: DataFrame, scale: float = 1.0, few: int = FEW_REGIONS) -> DataFrame:
    """Cells with each region that they overlap, and ``weight``, the share of the cell that lies in the region."""
    x, y = F.col("col") * scale, F.col("row") * scale
    width = F.least(x + scale, F.col("maxx")) - F.greatest(x, F.col("minx"))
    height = F.least(y + scale, F.col("maxy")) - F.greatest(y, F.col("miny"))
    # a region as wide as its outermost cells holds the centres of all that it overlaps
    wide = aois.select(*[c for c in aois.columns if c not in ("minx", "maxx", "miny", "maxy")], F.struct("minx", "maxx", "miny", "maxy").alias("box"),
                       *[(F.floor(F.col(c) / scale) * scale).alias(c) for c in ("minx", "miny")], *[(F.ceil(F.col(c) / scale) * scale).alias(c) for c in ("maxx", "maxy")])
    held = zonal_join(cells, wide, scale, few).drop("minx", "maxx", "miny", "maxy").withColumns({c: F.col(f"box.{c}") for c in ("minx", "maxx", "miny", "maxy")}).drop("box")
    return held.withColumn("weight", width * height / (scale * scale)).where("weight > 0")


def touches() -> F.Column:
    """Footprint t and region a overlap or touch."""
    return F.expr("t.minx <= a.maxx and t.maxx >= a.minx and t.miny <= a.maxy and t.maxy >= a.miny")


def tile_pairs(tiles: DataFrame, aois: DataFrame, few: int = FEW_REGIONS, size: float = 8.0) -> DataFrame:
    """Tiles (as t) with each region (as a) that they overlap or touch.

    Many regions meet the tiles in an equi-join on squares of that size; a pair counts in the square that
    holds the lower left corner of what both cover.
    """
    if few_regions(aois, few):
        return tiles.alias("t").join(F.broadcast(aois.alias("a")), touches())

    def laid(df: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size))
        return df.where("minx <= maxx and miny <= maxy").withColumn("bx", F.explode(span("minx", "maxx"))).withColumn("by", F.explode(span("miny", "maxy")))

    same = F.expr("t.bx = a.bx and t.by = a.by") & touches()
    corner = (F.floor(F.greatest("t.minx", "a.minx") / size) == F.col("t.bx")) & (F.floor(F.greatest("t.miny", "a.miny") / size) == F.col("t.by"))
    return laid(tiles).alias("t").join(laid(aois).alias("a"), same).where(corner)


def tile_hits(tiles: DataFrame, aois: DataFrame, few: int = FEW_REGIONS) -> DataFrame:
    """``(aoi, n_tiles, n_hits)``: how many tiles there are and how many meet each region."""
    hits = tile_pairs(tiles, aois, few).groupBy("a.aoi").agg(F.count("*").alias("n_hits"))
    total = tiles.agg(F.count("*").alias("n_tiles"))
    return aois.select("aoi").join(hits, "aoi", "left").crossJoin(F.broadcast(total)).select("aoi", "n_tiles", F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def tile_hit_list(tiles: DataFrame, aois: DataFrame) -> DataFrame:
    """``(aoi, position, tile_id)``: the tiles of each region, numbered from 0; one region's tiles are dealt to many tasks."""
    hits = tile_pairs(tiles, aois).select("a.aoi", "t.tile_id")
    return cumulative(hits, ["aoi"], [F.col("tile_id")]).withColumn("position", F.col("position").cast("int"))


#: the columns of a box
BOX = ("minx", "miny", "maxx", "maxy")


def bounded(shapes: DataFrame) -> DataFrame:
    """Shapes of one ``ring`` each with the box around it.

    The box is generated: Spark would push filters on computed columns below what makes the ring, and make it again for each.
    """
    edge = lambda f, axis: f(F.transform("ring", lambda p: p[axis]))
    box = F.struct(*[edge(F.array_max if c[:3] == "max" else F.array_min, c[-1]).alias(c) for c in BOX])
    return shapes.drop(*BOX).select("*", F.inline(F.array(box)))


def tile_areas(tiles: DataFrame, aois: DataFrame, metres: float = 10.0) -> DataFrame:
    """``(aoi, year, tile_id, area)``: tiles that meet a region with the area of their overlap.

    Where tiles or regions have a ``ring`` of points in place of a box, boxes around them find the pairs, and the
    tile's footprint is cut by the region's sides; the region has to be convex. Tiles are dealt to as many tasks as
    shuffles have partitions, for a layer of many footprints is a small file.
    """
    if "ring" in tiles.columns or "ring" in aois.columns:
        boxed = lambda df: bounded(df) if "ring" in df.columns else df.withColumn("ring", vector.box_ring(*[F.col(c) for c in BOX]))
        parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = tile_pairs(boxed(tiles.repartition(parts)), boxed(aois).withColumn("sides", vector.sides(F.col("ring"))))
        # a generated column is made once a pass, of pairs whose boxes meet: a filter on it can't go into the join
        cut = pairs.select("a.aoi", "t.year", "t.tile_id", F.explode(F.array(vector.cut(F.col("t.ring"), F.col("a.sides")))).alias("both"))
        return cut.where(F.size("both") > 0).select("aoi", "year", "tile_id", rounded(F.abs(vector.ring_area(F.col("both"))) * metres * metres).alias("area"))
    width = "greatest(0.0D, least(t.maxx, a.maxx) - greatest(t.minx, a.minx))"
    height = "greatest(0.0D, least(t.maxy, a.maxy) - greatest(t.miny, a.miny))"
    return tile_pairs(tiles, aois).select("a.aoi", "t.year", "t.tile_id", F.expr(f"{width} * {height} * {metres * metres}D").alias("area"))


def tile_rank(tiles: DataFrame, aois: DataFrame, metres: float = 10.0) -> DataFrame:
    """``(aoi, year, tile_id, area, rank)``: tiles that meet a region by falling area of overlap, then id; one region's tiles are dealt to many tasks."""
    ranked = cumulative(tile_areas(tiles, aois, metres), ["aoi"], [F.desc("area"), F.asc("tile_id")])
    return ranked.select("aoi", "year", "tile_id", rounded(F.col("area")).alias("area"), (F.col("position") + 1).cast("int").alias("rank"))


def best_tile(tiles: DataFrame, aois: DataFrame, by_year: bool = False, metres: float = 10.0) -> DataFrame:
    """``(aoi, year, tile_id, area)``: the first of that order for each region, or region and year; one aggregation, no sort of a region's tiles."""
    keys = ["aoi", "year"] if by_year else ["aoi"]
    best = tile_areas(tiles, aois, metres).groupBy(*keys).agg(F.min(F.struct((-F.col("area")).alias("less"), "tile_id", "year")).alias("b"))
    return best.select("aoi", "b.year", "b.tile_id", rounded(-F.col("b.less")).alias("area"))


def require_tiles(tiles: DataFrame, aois: DataFrame, year: int) -> DataFrame:
    """The year's tiles that meet a region; ValueError if there is none."""
    hits = tiles.where(F.col("year") == year).alias("t").join(aois.alias("a"), touches(), "left_semi")
    if hits.isEmpty():
        raise ValueError(f"no tile of {year} meets the region")
    return hits


def bbox_centre(boxes: DataFrame) -> DataFrame:
    return boxes.withColumn("cx", (F.col("minx") + F.col("maxx")) / 2).withColumn("cy", (F.col("miny") + F.col("maxy")) / 2)


def bbox_buffer(boxes: DataFrame, metres: float = 2500.0) -> DataFrame:
    """Each box replaced by the square of that radius around its centre, in degrees."""
    lat = F.lit(metres / 1000) / KM_PER_DEGREE
    lon = degrees_east(metres / 1000, F.col("cy"))
    edges = {"minx": F.col("cx") - lon, "maxx": F.col("cx") + lon, "miny": F.col("cy") - lat, "maxy": F.col("cy") + lat}
    return bbox_centre(boxes).withColumns({k: rounded(v) for k, v in edges.items()}).drop("cx", "cy")


def bbox_shift(boxes: DataFrame, km: float = 10.0) -> DataFrame:
    """Boxes moved east by so many kilometres at their centre's latitude."""
    east = degrees_east(km, F.col("cy"))
    return bbox_centre(boxes).withColumns({c: rounded(F.col(c) + east) for c in ("minx", "maxx")}).drop("cx", "cy")


def to_web_mercator(boxes: DataFrame) -> DataFrame:
    """Corners in degrees as Web Mercator metres."""
    (x0, y0), (x1, y1) = mercator(F.col("minx"), F.col("miny")), mercator(F.col("maxx"), F.col("maxy"))
    return boxes.withColumns({"minx": rounded(x0), "miny": rounded(y0), "maxx": rounded(x1), "maxy": rounded(y1)})


def band_names(cells: DataFrame, keys: list[str], band: str) -> DataFrame:
    """The names of the bands of each raster, one row each."""
    return cells.select(*keys, band).distinct()


def metadata(cells: DataFrame, keys: list[str], band: str, v: str) -> DataFrame:
    """Width, height, number of bands and value range of each raster."""
    return cells.groupBy(*keys).agg(
        (F.max("col") - F.min("col") + 1).alias("width"), (F.max("row") - F.min("row") + 1).alias("height"),
        F.count_distinct(band).alias("n_bands"), F.min(v).alias("min_v"), F.max(v).alias("max_v"))


def decimate(cells: DataFrame, k: int = 5) -> DataFrame:
    """The centre cell of each k x k block, on the coarser grid."""
    at = k // 2
    return cells.where((F.col("col") % k == at) & (F.col("row") % k == at)).withColumns({"col": F.expr(f"cast(col div {k} as int)"), "row": F.expr(f"cast(row div {k} as int)")})


def coarsen_to_budget(cells: DataFrame, v: str, max_pixels: int) -> DataFrame:
    """``(col, row, v, factor)``: block means on the finest grid of at most so many cells, and its factor.

    The factor comes from a count in the same plan, so nothing is sent to the driver.
    """
    size = cells.agg(F.greatest(F.lit(1), F.ceil(F.sqrt(F.count(v) / F.lit(max_pixels)))).cast("int").alias("factor"))
    laid = cells.crossJoin(F.broadcast(size))
    return laid.groupBy(F.expr("cast(col div factor as int)").alias("col"), F.expr("cast(row div factor as int)").alias("row"), "factor").agg(rounded(F.avg(v)).alias(v))


def resample_bilinear(cells: DataFrame, v: str, target: DataFrame, ratio: float) -> DataFrame:
    """``target`` cells with v interpolated from their four source neighbours, over those that are valid.

    ratio is the target cell's size in source cells. Each target cell asks for four source cells by an
    equi-join; no source cell is compared with more than those that ask for it.
    """
    fx, fy = (F.col("col") + 0.5) * ratio - 0.5, (F.col("row") + 0.5) * ratio - 0.5
    base = target.select("col", "row", fx.alias("fx"), fy.alias("fy")).withColumns({"c0": F.floor("fx").cast("int"), "r0": F.floor("fy").cast("int")})
    corner = base.withColumn("d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])))
    wx = F.when(F.col("d.i") == 1, F.col("fx") - F.col("c0")).otherwise(1 - (F.col("fx") - F.col("c0")))
    wy = F.when(F.col("d.j") == 1, F.col("fy") - F.col("r0")).otherwise(1 - (F.col("fy") - F.col("r0")))
    ask = corner.select("col", "row", (F.col("c0") + F.col("d.i")).alias("sc"), (F.col("r0") + F.col("d.j")).alias("sr"), (wx * wy).alias("w"))
    source = cells.select(F.col("col").alias("sc"), F.col("row").alias("sr"), F.col(v).alias("v"))
    got = ask.join(source, ["sc", "sr"], "left").withColumn("w", F.when(F.col("v").isNotNull(), F.col("w")))
    return got.groupBy("col", "row").agg(rounded(F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0.0))).alias(v))


def resample_nearest(cells: DataFrame, v: str, target: DataFrame, ratio: float) -> DataFrame:
    """``target`` cells with the v of the source cell that holds their centre."""
    ask = target.select("col", "row", F.floor((F.col("col") + 0.5) * ratio).cast("int").alias("sc"), F.floor((F.col("row") + 0.5) * ratio).cast("int").alias("sr"))
    source = cells.select(F.col("col").alias("sc"), F.col("row").alias("sr"), F.col(v).alias(v))
    return ask.join(source, ["sc", "sr"], "left").select("col", "row", v)


def coarse_grid(cells: DataFrame, k: int) -> DataFrame:
    """The cells of a grid k times as coarse that hold any cell."""
    return cells.select(F.expr(f"cast(col div {k} as int)").alias("col"), F.expr(f"cast(row div {k} as int)").alias("row")).distinct()

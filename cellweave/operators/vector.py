"""Vector layers: vertices of any GeoJSON geometry, projection both ways, cells in polygons, areas of intersections.

A geometry is ``parts``: parts of rings of points, each ``(x, y)``. A point, a line and a polygon are a part of
their own; a ring's last point repeats its first one. All are built-in functions: no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.columns import EARTH_RADIUS, mercator

#: columns of a block in which cells meet spans
BLOCK = 256
#: how deep coordinates are nested below a part's rings, by geometry type
_NESTED = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}
DEGREES, METRES = "EPSG:4326", "EPSG:3857"


def parts(geometry_type: Column, coordinates: Column) -> Column:
    """JSON coordinates of any type as ``array<array<array<struct<x, y>>>>``; null for a type without coordinates.

    Points of a multi-point are parts of one point each, lines of a multi-line are parts of one ring.
    """
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    line = lambda ps: F.transform(ps, point)
    read = lambda depth: F.from_json(coordinates, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    of = {
        "Point": F.array(F.array(F.array(point(read(0))))), "MultiPoint": F.transform(read(1), lambda p: F.array(F.array(point(p)))), "LineString": F.array(F.array(line(read(1)))),
        "MultiLineString": F.transform(read(2), lambda ps: F.array(line(ps))), "Polygon": F.array(F.transform(read(2), line)), "MultiPolygon": F.transform(read(3), lambda rings: F.transform(rings, line)),
    }
    out = F.lit(None)
    for name, made in of.items():
        out = F.when(geometry_type == name, made).otherwise(out)
    return out


def text(geometry_type: Column, geometry: Column) -> Column:
    """Parts as JSON coordinates of their type."""
    point = lambda p: F.array(p["x"], p["y"])
    line = lambda ps: F.transform(ps, point)
    of = {
        "Point": F.to_json(point(geometry[0][0][0])), "MultiPoint": F.to_json(F.transform(geometry, lambda p: point(p[0][0]))), "LineString": F.to_json(line(geometry[0][0])),
        "MultiLineString": F.to_json(F.transform(geometry, lambda p: line(p[0]))), "Polygon": F.to_json(F.transform(geometry[0], line)), "MultiPolygon": F.to_json(F.transform(geometry, lambda p: F.transform(p, line))),
    }
    out = F.lit(None).cast("string")
    for name, made in of.items():
        out = F.when(geometry_type == name, made).otherwise(out)
    return out


def with_parts(layer: DataFrame) -> DataFrame:
    """A layer as ``tables.geojson`` reads it, with ``parts`` in place of its coordinates' text."""
    return layer.withColumn("parts", parts(F.col("geometry_type"), F.col("coordinates"))).drop("coordinates")


def vertices(layer: DataFrame) -> DataFrame:
    """A row for each vertex of ``parts``: the other columns, and ``(part, ring, vertex, x, y)``, numbered from 0."""
    rest = [c for c in layer.columns if c != "parts"]
    out = layer.select(*rest, F.posexplode("parts").alias("part", "rings")).select(*rest, "part", F.posexplode("rings").alias("ring", "points"))
    return out.select(*rest, "part", "ring", F.posexplode("points").alias("vertex", "p")).select(*rest, "part", "ring", "vertex", "p.x", "p.y")


def assembled(points: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices put together again: ``(keys, parts)``, whatever their order or partitioning."""
    in_order = lambda number, v: F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), v.alias("v")))), lambda x: x["v"])
    rings = points.groupBy(*keys, "part", "ring").agg(in_order("vertex", F.struct("x", "y")).alias("points"))
    return rings.groupBy(*keys, "part").agg(in_order("ring", F.col("points")).alias("rings")).groupBy(*keys).agg(in_order("part", F.col("rings")).alias("parts"))


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of Web Mercator metres."""
    return F.degrees(x / EARTH_RADIUS), F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - F.lit(3.141592653589793) / 2)


def projection(source: str, target: str):
    """The function of (x, y) from one coordinate system to another; ValueError if there is none."""
    known = {(DEGREES, METRES): mercator, (METRES, DEGREES): inverse_mercator}
    if source == target and source in (DEGREES, METRES):
        return lambda x, y: (x, y)
    if (source, target) not in known:
        raise ValueError(f"no way from {source} to {target}; {DEGREES} and {METRES} are known")
    return known[source, target]


def reproject(layer: DataFrame, target: str) -> DataFrame:
    """A layer whose rows may have different ``crs``, vertex by vertex, with ``parts`` and crs of the target.

    Vertices beyond the projection's range have a null y; parts of an unknown crs are null.
    """

    def moved(source: str) -> Column:
        way = projection(source, target)

        def point(p):
            x, y = way(p["x"], p["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        return F.transform("parts", lambda rings: F.transform(rings, lambda ps: F.transform(ps, point)))

    made = F.when(F.col("crs") == DEGREES, moved(DEGREES)).when(F.col("crs") == METRES, moved(METRES))
    return layer.withColumn("parts", made).withColumn("crs", F.lit(target))


def as_geojson(layer: DataFrame) -> DataFrame:
    """``value``: each feature with its ``properties`` map as a line of GeoJSON, for ``write.text``; ``tables.geojson(lines=True)`` reads it."""
    feature = F.struct(
        F.lit("FeatureCollection").alias("type"), F.struct(F.lit("name").alias("type"), F.struct(F.col("crs").alias("name")).alias("properties")).alias("crs"),
        F.array(F.struct(F.lit("Feature").alias("type"), "properties", F.struct(F.col("geometry_type").alias("type"), F.lit("@").alias("coordinates")).alias("geometry"))).alias("features"))
    # numbers stay as they are written: the text takes the place of a mark that no quoted text can hold
    return layer.select(F.replace(F.to_json(feature), F.lit('"coordinates":"@"'), F.concat(F.lit('"coordinates":'), text(F.col("geometry_type"), F.col("parts")))).alias("value"))


# cells in polygons


def edges(polygons: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, x0, y0, x1, y1)``: the sides of all rings."""
    rings = F.flatten("parts")
    side = lambda ps: F.transform(F.slice(ps, 2, F.size(ps)), lambda q, i: F.struct(ps[i]["x"].alias("x0"), ps[i]["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1")))
    return polygons.select(*keys, F.explode(F.flatten(F.transform(rings, side))).alias("e")).select(*keys, "e.*")


def spans(polygons: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """``(keys, row, c0, c1)``: the stretches of each row whose cells' centres lie in a polygon, by scanlines.

    Each side crosses the centre lines of the rows from its lower end up to, not including, its upper end; a row's
    crossings in order, taken two by two, are its stretches (the even-odd rule, so rings inside rings are holes). A
    centre on a left or lower side is in, on a right or upper one is out.
    """
    y0, y1 = F.least("y0", "y1") / scale, F.greatest("y0", "y1") / scale
    first, end = F.ceil(y0 - 0.5).cast("long"), F.ceil(y1 - 0.5).cast("long") - 1
    laid = edges(polygons, keys).where(first <= end).withColumn("row", F.explode(F.sequence(first, end)))
    at = F.col("x0") + ((F.col("row") + 0.5) * scale - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossed = laid.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(at / scale)).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs").cast("int") - 2, F.lit(2)), lambda i: F.struct(F.ceil(F.col("xs")[i] - 0.5).cast("int").alias("c0"), (F.ceil(F.col("xs")[i + 1] - 0.5) - 1).cast("int").alias("c1")))
    out = crossed.where(F.size("xs") >= 2).select(*keys, F.col("row").cast("int").alias("row"), F.explode(pairs).alias("s"))
    return out.select(*keys, "row", "s.c0", "s.c1").where("c0 <= c1")


def polygon_join(cells: DataFrame, polygons: DataFrame, scale: float = 1.0) -> DataFrame:
    """Cells with each polygon that holds their centre: ``polygons`` columns but ``parts``.

    Stretches are cut at blocks of columns and meet cells in an equi-join on row and block, so no cell is compared
    with the polygons of other rows. Polygons of one row each are kept apart by a number of their own.
    """
    rest = [F.col(c) for c in polygons.columns if c != "parts"]
    named = polygons.select(F.struct(*rest).alias("region"), "parts")
    held = spans(named, ["region"], scale).withColumn("bx", F.explode(F.sequence(F.floor(F.col("c0") / BLOCK), F.floor(F.col("c1") / BLOCK))))
    laid = held.select("region", F.col("row").alias("at_row"), "bx", "c0", "c1")
    found = cells.withColumn("at_block", F.floor(F.col("col") / BLOCK)).join(laid, (F.col("row") == F.col("at_row")) & (F.col("at_block") == F.col("bx")) & F.col("col").between(F.col("c0"), F.col("c1")))
    return found.select(*cells.columns, "region.*")


# areas


def _next(ring: Column) -> Column:
    """The ring from its second point on, then the first one: at each place the point that follows."""
    return F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))


def ring_area(ring: Column) -> Column:
    """The signed area of a ring of points, positive if they run anticlockwise; closed or not."""
    terms = F.zip_with(ring, _next(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0)) / 2


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(minx, miny), corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy))


def open_ring(ring: Column) -> Column:
    """Without the last point where that repeats the first one."""
    return F.when((F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1)), F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def sides(convex: Column) -> Column:
    """The sides of a convex ring, anticlockwise, that ``cut`` takes; the ring may run in either direction."""
    convex = open_ring(convex)
    convex = F.when(ring_area(convex) < 0, F.reverse(convex)).otherwise(convex)
    return F.zip_with(convex, _next(convex), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def cut(subject: Column, sides: Column) -> Column:
    """The part of a ring inside a convex one, cut by the half-plane of one of its sides after the other; empty if they are apart.

    Points on a side count as inside, so rings that only touch leave points without area. A subject that isn't
    convex may come out with sides that cover each other; its area is right all the same.
    """

    def half(ring, side):
        a, b = side["p"], side["q"]
        left = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
        placed = F.transform(ring, lambda p: F.struct(p.alias("p"), left(p).alias("left")))

        def step(here, there):
            p, q, d, e = here["p"], there["p"], here["left"], there["left"]
            t = d / (d - e)
            crossing = F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y"))
            none = F.filter(F.array(q), lambda z: F.lit(False))
            return F.when((d >= 0) & (e >= 0), F.array(q)).when((d > 0) & (e < 0), F.array(crossing)).when((d < 0) & (e > 0), F.array(crossing, q)).when(e >= 0, F.array(q)).otherwise(none)

        return F.flatten(F.zip_with(placed, _next(placed), step))

    return F.aggregate(sides, open_ring(subject), half)


def clipped(subject: Column, convex: Column) -> Column:
    """The part of a ring inside a convex one: ``cut`` by its ``sides``. Where one convex ring meets many, a column of its sides saves making them for each."""
    return cut(subject, sides(convex))


def intersection_area(subject: Column, convex: Column) -> Column:
    return F.abs(ring_area(clipped(subject, convex)))

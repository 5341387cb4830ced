"""Vector layers beside plain Python: geometry types, projection both ways, cells in polygons, areas."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import grid, vector, zonal
from cellweave.sources import tables

LAYER = "name string, crs string, geometry_type string, coordinates string"
GEOMETRIES = {
    "Point": [3.5, -2.25], "MultiPoint": [[0.0, 1.0], [2.0, 3.0]], "LineString": [[0.0, 0.0], [1.0, 2.0], [-3.0, 4.5]], "MultiLineString": [[[0.0, 0.0], [1.0, 1.0]], [[5.0, 5.0], [6.0, 7.0], [8.0, 9.0]]],
    "Polygon": [[[0.0, 0.0], [9.0, 1.0], [8.0, 7.0], [0.0, 0.0]], [[5.0, 2.0], [6.0, 3.0], [6.0, 2.0], [5.0, 2.0]]],
    "MultiPolygon": [[[[0.0, 0.0], [4.0, 0.0], [2.0, 3.0], [0.0, 0.0]]], [[[10.0, 10.0], [14.0, 10.0], [14.0, 15.0], [10.0, 10.0]], [[12.0, 11.0], [13.0, 11.0], [13.0, 12.0], [12.0, 11.0]]]],
}


def layer(spark, crs=vector.DEGREES):
    return vector.with_parts(spark.createDataFrame([(k, crs, k, json.dumps(v)) for k, v in GEOMETRIES.items()], LAYER))


def close(a, b):
    return all(map(close, a, b)) and len(a) == len(b) if isinstance(a, list) else abs(a - b) < 1e-6


def test_every_geometry_type_round_trips(spark):
    there = vector.vertices(vector.reproject(layer(spark), vector.METRES)).repartition(5, "x")
    back = vector.reproject(vector.assembled(there, ["name", "geometry_type", "crs"]), vector.DEGREES)
    got = {r.name: json.loads(r.c) for r in back.select("name", vector.text(F.col("geometry_type"), F.col("parts")).alias("c")).collect()}
    assert got.keys() == GEOMETRIES.keys() and all(close(got[k], v) for k, v in GEOMETRIES.items())
    x, y = next((r.x, r.y) for r in there.where("name = 'Point'").collect())
    assert x == pytest.approx(math.radians(3.5) * 6378137.0) and y == pytest.approx(math.log(math.tan(math.pi / 4 + math.radians(-2.25) / 2)) * 6378137.0)


def test_vertices_are_numbered_by_part_and_ring(spark):
    got = sorted((r.part, r.ring, r.vertex, r.x, r.y) for r in vector.vertices(layer(spark)).where("name = 'MultiPolygon'").collect())
    assert got == [(i, j, k, *p) for i, rings in enumerate(GEOMETRIES["MultiPolygon"]) for j, ps in enumerate(rings) for k, p in enumerate(ps)]


def test_odd_layers(spark):
    rows = [("none", None, None, None), ("bare", "EPSG:4326", "GeometryCollection", None), ("bad", "EPSG:4326", "Polygon", "[[["), ("far", "EPSG:9999", "Point", "[1,2]"), ("pole", "EPSG:4326", "Point", "[0,90]"), ("empty", "EPSG:4326", "MultiPolygon", "[]")]
    df = vector.with_parts(spark.createDataFrame(rows, LAYER))
    assert sorted(r.name for r in vector.vertices(df).where("x is not null").collect()) == ["far", "pole"]
    moved = {r.name: r.parts for r in vector.reproject(df, vector.METRES).collect()}
    assert moved["far"] is None and moved["pole"][0][0][0].y is None and moved["empty"] == []
    with pytest.raises(ValueError):
        vector.projection("EPSG:4326", "EPSG:32611")
    assert vector.vertices(df.limit(0)).count() == 0


def test_a_layer_is_written_and_read_by_lines(spark, tmp_path):
    held = layer(spark).withColumn("properties", F.create_map(F.lit("name"), F.concat(F.col("name"), F.lit(' "@" é'))))
    vector.as_geojson(held).coalesce(1).write.text(f"{tmp_path}/layer")
    got = {r.properties["name"].split()[0]: json.loads(r.coordinates) for r in tables.geojson(spark, f"file://{tmp_path}/layer", lines=True).collect()}
    assert got == GEOMETRIES


def even_odd(x, y, rings):
    odd = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if (y0 <= y) != (y1 <= y) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) <= x:
                odd = not odd
    return odd


def shapes(r):
    """Stars with holes, at odd places, some off the grid."""
    out = {}
    for k in range(12):
        cx, cy = r.uniform(-10, 60), r.uniform(-5, 40)
        star = [(cx + r.uniform(2, 14) * math.cos(a), cy + r.uniform(2, 14) * math.sin(a)) for a in sorted(r.uniform(0, 2 * math.pi) for _ in range(9))]
        hole = [(cx - 0.7, cy - 0.7), (cx + 0.8, cy - 0.6), (cx, cy + 1.1)]
        out[f"s{k}"] = [[*star, star[0]], [*hole, hole[0]]]
    out["square"] = [[(5.5, 5.5), (8.5, 5.5), (8.5, 9.5), (5.5, 9.5), (5.5, 5.5)]]  # sides on cells' centres
    return out


@pytest.mark.parametrize("scale", [1.0, 2.5])
def test_cells_in_polygons(spark, scale, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 16)
    made = shapes(random.Random(4))
    polygons = vector.with_parts(spark.createDataFrame([(k, "x", "Polygon", json.dumps(v)) for k, v in made.items()], "aoi string, crs string, geometry_type string, coordinates string"))
    cells = spark.createDataFrame([(c, r, float(c * r)) for c in range(-8, 50) for r in range(-6, 40)], "col int, row int, v double")
    got = sorted((r.aoi, r.col, r.row) for r in vector.polygon_join(cells, polygons, scale).collect())
    assert got == sorted((k, c, r) for k, rings in made.items() for c in range(-8, 50) for r in range(-6, 40) if even_odd((c + 0.5) * scale, (r + 0.5) * scale, rings))
    if scale == 1.0:
        assert {(c, r) for k, c, r in got if k == "square"} == {(c, r) for c in (5, 6, 7) for r in (5, 6, 7, 8)}
        stats = {r.aoi: r for r in zonal.zonal_stats(cells, "v", polygons.select("aoi", "parts")).collect()}
        assert stats["square"]["count"] == 12 and stats["square"]["max"] == 56.0 and set(stats) == set(made)
        assert vector.polygon_join(cells, polygons.limit(0)).count() == 0


def area(spark, subject, convex):
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in subject], [{"x": x, "y": y} for x, y in convex])], "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    return df.select(vector.intersection_area(F.col("a"), F.col("b")).alias("v")).first().v


SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]


@pytest.mark.parametrize(("subject", "convex", "expected"), [
    (SQUARE, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)], 1.0), (SQUARE, SQUARE, 4.0), (SQUARE, list(reversed(SQUARE)), 4.0), (SQUARE, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)], 0.0), (SQUARE, [(2.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0)], 0.0),
    (SQUARE, [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)], 4.0), (SQUARE, [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)], 2.0), (SQUARE, [(1.0, -1.0), (3.0, 1.0), (1.0, 3.0), (-1.0, 1.0)], 4.0), (SQUARE, [(1.0, 0.0), (2.0, 1.0), (1.0, 2.0), (0.0, 1.0)], 2.0),
    ([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0)], [(0.0, 1.0), (4.0, 1.0), (4.0, 2.0), (0.0, 2.0)], 3.0), ([*SQUARE, SQUARE[0]], [(0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5), (0.5, 0.5)], 1.0),
])
def test_areas_of_intersections(spark, subject, convex, expected):
    assert area(spark, subject, convex) == pytest.approx(expected, abs=1e-12)
    assert area(spark, list(reversed(subject)), convex) == pytest.approx(expected, abs=1e-12)


def test_slanted_footprints_are_ranked_by_area(spark):
    ring = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    tiles = spark.createDataFrame([(1, 2001, ring((0, 0), (4, 0), (6, 4), (2, 4))), (2, 2001, ring((3, 0), (6, 3), (3, 6), (0, 3))), (3, 2001, ring((20, 20), (21, 20), (21, 22)))], "tile_id int, year int, ring array<struct<x: double, y: double>>")
    aois = spark.createDataFrame([("box", 0, 0.0, 0.0, 3.0, 3.0)], "aoi string, pos int, minx double, miny double, maxx double, maxy double")
    got = [(r.tile_id, r.area, r["rank"]) for r in grid.tile_rank(tiles, aois, 1.0).orderBy("rank").collect()]
    # the parallelogram leaves a triangle of 1.5 x 3 / 2 of the square, the rhombus covers half of it
    assert got == [(1, 6.75, 1), (2, 4.5, 2)]
    three = spark.createDataFrame([("tri", ring((0, 0), (3, 0), (0, 3)))], "aoi string, ring array<struct<x: double, y: double>>")
    best = grid.best_tile(tiles, three, metres=1.0).collect()
    assert [(r.aoi, r.tile_id, r.area) for r in best] == [("tri", 1, 3.0)]


def test_footprints_are_made_and_cut_once_by_many_tasks(spark):
    x = F.col("id") * 3
    text = F.format_string("[[%s.0,0.0],[%s.0,0.0],[%s.0,2.0],[%s.0,2.0]]", x, x + 2, x + 3, x + 1)
    ring = F.transform(F.from_json(text, "array<array<double>>"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    tiles = spark.range(0, 40, 1, 1).select(F.col("id").alias("tile_id"), F.lit(2001).alias("year"), ring.alias("ring"))
    aois = spark.createDataFrame([("low", 0, 0.0, 0.0, 30.0, 1.0), ("all", 1, 0.0, 0.0, 200.0, 2.0), ("apart", 2, 0.0, 5.0, 200.0, 9.0)], "aoi string, pos int, minx double, miny double, maxx double, maxy double")
    areas = grid.tile_areas(tiles, aois, 1.0)
    # tile 10 touches the low region in a point
    expected = {("low", k): 2.0 if k < 10 else 0.0 for k in range(11)} | {("all", k): 4.0 for k in range(40)}
    assert {(r.aoi, r.tile_id): r.area for r in areas.collect()} == expected
    plan = areas._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) == 1 and "flatten(" not in joins[0]
    assert plan.count("from_json(") == plan.count("flatten(") == 1
    assert tiles.rdd.getNumPartitions() == 1 and areas.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))

"""Every registered query, with the same result in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.columns import finite, rounded
from cellweave.operators import grid, pyramid, qc, resample, sampling, shift, temporal, vector, zonal
from cellweave.sources import tables
from cellweave.sources.tables import VIEWS, table, view

YEAR, FIRST, LAST = 2001, 1995, 2001
BANDS = ["afg", "pfg", "shr", "tre", "ltr", "bgr"]

def top() -> Column:
    """The views' order of observations, the last one on top, packed into one number that a hash aggregate can hold."""
    return F.expr("""((((cast(tile_id as decimal(38, 0)) * 10000000 + l_suppkey) * 100000000000 + l_orderkey) * 10 + l_linenumber) * 1000000000
+ cast(round(l_extendedprice * 100) as bigint)) * 100000 + datediff(l_shipdate, date'1970-01-01')""")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            more = f", {sql[5:]}" if sql.startswith("with ") else f"\n{sql}"
            SQL[f.__name__] = f"with {', '.join(f'{k} as ({v})' for k, v in VIEWS.items())}, {_SHARED}{more}"
        return f

    return add


_ORDER = "tile_id desc, l_suppkey desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_shipdate desc"
_top = lambda b: f"first({b} order by {_ORDER}) filter (where {b} is not null) as {b}"
_IN = "c.col + 0.5 >= a.minx and c.col + 0.5 < a.maxx and c.row + 0.5 >= a.miny and c.row + 0.5 < a.maxy"
_MEET = "t.minx <= a.maxx and t.maxx >= a.minx and t.miny <= a.maxy and t.maxy >= a.miny"
_SHARED = f"""mos as (select year, col, row, {', '.join(map(_top, BANDS))} from pix group by year, col, row),
cells as (select * from mos where year = {YEAR}),
zone as (select a.aoi, c.* from cells c join aois a on {_IN}),
ranked as (select a.aoi, t.year, t.tile_id, greatest(0.0, least(t.maxx, a.maxx) - greatest(t.minx, a.minx)) * greatest(0.0, least(t.maxy, a.maxy) - greatest(t.miny, a.miny)) * 100.0 as area
           from tiles t join aois a on {_MEET}),
feat as (select col, row, round(avg(shr), 6) as mean, round(stddev_pop(shr), 6) as std, round(max(shr) filter (where year = {LAST}) - max(shr) filter (where year = {FIRST}), 6) as change,
         round(case when regr_count(shr, year) > 1 then regr_slope(shr, year) end, 6) as trend,
         cast(max(shr) filter (where year = {LAST}) >= 5 as int) as ge5, cast(max(shr) filter (where year = {LAST}) >= 10 as int) as ge10 from mos group by col, row),
pts as (select a.aoi, a.pos, i as point_id, a.minx + cast(('0x' || substr(md5(concat_ws(':', 42, 'x', i)), 1, 8)) as bigint) / 4294967296.0 * (a.maxx - a.minx) as x,
               a.miny + cast(('0x' || substr(md5(concat_ws(':', 42, 'y', i)), 1, 8)) as bigint) / 4294967296.0 * (a.maxy - a.miny) as y
        from aois a, range(5000) r(i) where a.maxx > a.minx and a.maxy > a.miny),
samp as (select p.aoi, p.pos, p.point_id, p.x, p.y, cast(floor(p.x) as int) as col, cast(floor(p.y) as int) as row, c.shr
         from pts p join cells c on c.col = floor(p.x) and c.row = floor(p.y) where c.shr is not null)"""
_STATS = """count({v}) as count, round(avg({v}), 6) as mean, round(median({v}), 6) as median, round(min({v}), 6) as min, round(max({v}), 6) as max, round(stddev_pop({v}), 6) as std,
round(quantile_cont({v}, 0.05), 6) as p05, round(quantile_cont({v}, 0.25), 6) as p25, round(quantile_cont({v}, 0.75), 6) as p75, round(quantile_cont({v}, 0.95), 6) as p95"""


def aois(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "aois")


def cells(spark: SparkSession, d: str, year: int = YEAR, bands: list[str] = BANDS) -> DataFrame:
    """The mosaic of one year; the filter reaches the scan before tiles are merged."""
    return temporal.mosaic(tables.pix_of(spark, d, year, year), bands, top())


def samples(spark: SparkSession, d: str) -> DataFrame:
    return sampling.at_points(sampling.random_points(aois(spark, d)), cells(spark, d, bands=["shr"]), ["shr"])


# scans and metadata


@query(f"select tile_id, year, col, row, shr as cover from pix where year = {YEAR}")
def scan_pixels(spark, d):
    return tables.pix_of(spark, d, YEAR, YEAR).select("tile_id", "year", "col", "row", F.col("shr").alias("cover"))


@query(f"select tile_id, year, col, row, shr as cover from pix where year = {YEAR}")
def scan_partitioned(spark, d):
    """The same from a collection with a folder for each year, of which one is read."""
    path = f"{tables.shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    tables.write_cells(view(spark, d, "pix").select("tile_id", "year", "col", "row", "shr"), path)
    return tables.read_cells(spark, path, YEAR).select("tile_id", "year", "col", "row", F.col("shr").alias("cover"))


@query("""select c.col, c.row, c.shr from cells c where exists (select * from aois a where a.maxx > a.minx and a.maxy > a.miny
and floor(c.col / 16) between floor(a.minx / 16) and floor(a.maxx / 16) and floor(c.row / 16) between floor(a.miny / 16) and floor(a.maxy / 16))""")
def scan_by_region(spark, d):
    """The year's cells from a collection in folders by square, of which those of the regions' squares are read."""
    path = f"{tables.shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    tables.write_cells(cells(spark, d, bands=["shr"]), path, area=16)
    return tables.cells_near(tables.read_cells(spark, path, YEAR), aois(spark, d), 16).select("col", "row", "shr")


@query("select file, col, row, v from raster_cells where band = 1")
def raster_band_scan(spark, d):
    return view(spark, d, "raster_cells").where("band = 1").select("file", "col", "row", "v")


@query("select file, count(*) as n_cells from raster_cells group by file")
def file_inventory(spark, d):
    return tables.inventory(view(spark, d, "raster_cells"))


_RING = "'[[[' || minx || ',' || miny || '],[' || maxx || ',' || miny || '],[' || maxx || ',' || maxy || '],[' || minx || ',' || maxy || '],[' || minx || ',' || miny || ']]]'"


@query(f"select 'EPSG:4326' as crs, 'Polygon' as geometry_type, {_RING} as coordinates, aoi as name from aois")
def geojson_scan(spark, d):
    """The regions written as a GeoJSON layer to the shared folder, and read as one."""
    path = f"{tables.shared_folder(spark)}/geojson-{uuid.uuid4().hex}"
    ring = F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]", *[F.col(c).cast("string") for c in ("minx", "miny", "maxx", "miny", "maxx", "maxy", "minx", "maxy", "minx", "miny")])
    one = F.format_string('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"%s"},"geometry":{"type":"Polygon","coordinates":%s}}]}', "aoi", ring)
    aois(spark, d).select(one.alias("value")).repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return tables.geojson(spark, path).withColumn("name", F.col("properties")["name"]).drop("properties")


@query("""select file, cast(max(col) - min(col) + 1 as int) as width, cast(max(row) - min(row) + 1 as int) as height, count(distinct band) as n_bands, min(v) as min_v, max(v) as max_v from raster_cells group by file""")
def grid_metadata(spark, d):
    return grid.metadata(view(spark, d, "raster_cells"), ["file"], "band", "v")


@query("select s.*, (select count(*) from supplier) as n_rows, cast(4 as int) as n_columns from supplier s order by s_suppkey limit 5")
def table_shape_preview(spark, d):
    return tables.preview(table(spark, d, "supplier"), ["s_suppkey"])


@query("unpivot (select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation order by nation.n_nationkey limit 1) on columns(*) into name field value value")
def first_row_fields(spark, d):
    return tables.first_row(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("select cast(row_number() over () - 1 as int) as position, dimension from (unpivot (select cast(x as varchar) as x, cast(y as varchar) as y, cast(z as varchar) as z, cast(classification as varchar) as classification from cloud limit 1) on columns(*) into name dimension value v)")
def pointcloud_dimensions(spark, d):
    return qc.dimensions(view(spark, d, "cloud"))


@query("select distinct file, band from raster_cells")
def raster_bands(spark, d):
    return grid.band_names(view(spark, d, "raster_cells"), ["file"], "band")


@query("select file, count(*) as n_points, min(z) as min_z, max(z) as max_z, cast(4 as int) as n_dimensions from cloud group by file")
def pointcloud_elevation(spark, d):
    return qc.elevation(view(spark, d, "cloud"))


@query("select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING'")
def attribute_filter(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name", "c_acctbal")


# tiles


@query(f"select a.aoi, count(*) as n_tiles, cast(count(*) filter (where {_MEET}) as bigint) as n_hits from tiles t, aois a group by a.aoi")
def tile_hits(spark, d):
    return grid.tile_hits(view(spark, d, "tiles"), aois(spark, d))


@query(f"select a.aoi, t.tile_id, cast(row_number() over (partition by a.aoi order by t.tile_id) - 1 as int) as position from tiles t join aois a on {_MEET}")
def tile_hit_list(spark, d):
    return grid.tile_hit_list(view(spark, d, "tiles"), aois(spark, d))


@query("select aoi, year, tile_id, round(area, 6) as area, cast(row_number() over (partition by aoi order by area desc, tile_id) as int) as rank from ranked")
def tile_rank(spark, d):
    return grid.tile_rank(view(spark, d, "tiles"), aois(spark, d))


@query("select aoi, year, tile_id, round(area, 6) as area from ranked qualify row_number() over (partition by aoi, year order by area desc, tile_id) = 1")
def best_tile_per_year(spark, d):
    return grid.best_tile(view(spark, d, "tiles"), aois(spark, d), by_year=True)


@query("select * from mos")
def mosaic(spark, d):
    return temporal.mosaic(view(spark, d, "pix"), BANDS, top())


# vector layers


def plots(spark: SparkSession, d: str) -> DataFrame:
    """Slanted polygons and multi-polygons, every second one with a hole, written as a GeoJSON layer and read as one."""
    path = f"{tables.shared_folder(spark)}/layer-{uuid.uuid4().hex}"
    held = view(spark, d, "plots").withColumns({"crs": F.lit(vector.DEGREES), "properties": F.create_map(F.lit("name"), "name")})
    vector.as_geojson(vector.with_parts(held)).write.text(path)
    layer = vector.with_parts(tables.geojson(spark, path, lines=True))
    return layer.withColumn("name", F.col("properties")["name"]).drop("properties")


#: a row for each vertex of the plots, and their sides
_VERTICES = """rings as (select name, geometry_type, case when geometry_type = 'Polygon' then [from_json(coordinates, '[[["DOUBLE"]]]')] else from_json(coordinates, '[[[["DOUBLE"]]]]') end as parts from plots),
p1 as (select name, geometry_type, unnest(parts) as rings, generate_subscripts(parts, 1) - 1 as part from rings),
p2 as (select name, geometry_type, part, unnest(rings) as points, generate_subscripts(rings, 1) - 1 as ring from p1),
verts as (select name, geometry_type, cast(part as int) as part, cast(ring as int) as ring, cast(generate_subscripts(points, 1) - 1 as int) as vertex, unnest(points) as p from p2),
sides as (select name, p[1] as x0, p[2] as y0, q[1] as x1, q[2] as y1 from (select name, p, lead(p) over (partition by name, part, ring order by vertex) as q from verts) where q is not null),
held as (select s.name, c.col, c.row, c.shr from cells c join sides s on (s.y0 <= c.row + 0.5) <> (s.y1 <= c.row + 0.5) and s.x0 + (c.row + 0.5::double - s.y0) * (s.x1 - s.x0) / (s.y1 - s.y0) <= c.col + 0.5
         group by all having count(*) % 2 = 1)"""


@query(f"with {_VERTICES} select name, geometry_type, part, ring, vertex, round(radians(p[1]) * 6378137.0::double, 6) as x, round(ln(tan(pi() / 4 + radians(p[2]) / 2)) * 6378137.0::double, 6) as y from verts")
def layer_vertices(spark, d):
    """The layer's vertices in Web Mercator."""
    return vector.vertices(vector.reproject(plots(spark, d), vector.METRES)).drop("crs").withColumns({"x": rounded(F.col("x")), "y": rounded(F.col("y"))})


@query("select name, geometry_type, 'EPSG:4326' as crs, coordinates from plots")
def layer_round_trip(spark, d):
    """To Web Mercator and back by vertices, rings put together again: the layer as it was written."""
    there = vector.vertices(vector.reproject(plots(spark, d), vector.METRES))
    back = vector.reproject(vector.assembled(there, ["name", "geometry_type", "crs"]), vector.DEGREES)
    near = F.transform("parts", lambda rings: F.transform(rings, lambda ps: F.transform(ps, lambda p: F.struct(rounded(p["x"]).alias("x"), rounded(p["y"]).alias("y")))))
    return back.select("name", "geometry_type", "crs", vector.text(F.col("geometry_type"), near).alias("coordinates"))


@query(f"with {_VERTICES} select name, col, row, shr from held")
def cells_in_polygons(spark, d):
    return vector.polygon_join(cells(spark, d, bands=["shr"]).drop("year"), plots(spark, d).select("name", "parts"))


@query(f"with {_VERTICES} select a.name as aoi, {_STATS.format(v='z.shr')} from plots a left join held z on z.name = a.name group by a.name")
def zonal_stats_polygons(spark, d):
    return zonal.zonal_stats(cells(spark, d, bands=["shr"]), "shr", plots(spark, d).select(F.col("name").alias("aoi"), "parts"))


def footprints(spark: SparkSession, d: str) -> DataFrame:
    """Slanted footprints of the tiles: the plots' first rings."""
    of = view(spark, d, "plots").withColumns({"parts": vector.parts(F.col("geometry_type"), F.col("coordinates")), "tile_id": F.regexp_extract("name", "[0-9]+", 0).cast("long")})
    return of.select("tile_id", (1995 + F.col("tile_id") % 7).cast("int").alias("year"), F.col("parts")[0][0].alias("ring"))


#: the area under a side within the box is that of its height above the lower edge, cut off at the upper one
_H = "case when {y} < miny then 0 when {y} <= maxy then ({y} - miny) * ({y} - miny) / 2 else (maxy - miny) * (maxy - miny) / 2 + ({y} - maxy) * (maxy - miny) end"
_AT = "(y0 + ({x} - x0) * (y1 - y0) / (x1 - x0))"


@query(f"""with {_VERTICES}, first as (select name, p[1] as x0, p[2] as y0, lead(p[1]) over w as x1, lead(p[2]) over w as y1 from verts where part = 0 and ring = 0 window w as (partition by name order by vertex)),
cut as (select aoi, name, minx, maxx, miny, maxy, x0, y0, x1, y1, least(greatest(x0, minx), maxx) as a, least(greatest(x1, minx), maxx) as b from first, aois where x1 is not null and maxy > miny),
under as (select aoi, name, -sum(case when x1 = x0 or a = b then 0 when y1 = y0 then (least(greatest(y0, miny), maxy) - miny) * (b - a)
 else ({_H.format(y=_AT.format(x='b'))} - ({_H.format(y=_AT.format(x='a'))})) * (x1 - x0) / (y1 - y0) end) * 100 as area from cut group by all)
select aoi, cast(1995 + cast(name[5:] as bigint) % 7 as int) as year, cast(name[5:] as bigint) as tile_id, round(area, 6) as area, cast(row_number() over (partition by aoi order by round(area, 6) desc, cast(name[5:] as bigint)) as int) as rank from under where area > 1e-6""")
def footprint_rank(spark, d):
    """Slanted footprints by the area that they share with each region."""
    return grid.tile_rank(footprints(spark, d), aois(spark, d)).where("area > 0")


# regions


@query(f"select a.aoi, {_STATS.format(v='z.shr')} from aois a left join zone z on z.aoi = a.aoi group by a.aoi")
def zonal_stats(spark, d):
    return zonal.zonal_stats(cells(spark, d), "shr", aois(spark, d))


@query("select a.aoi, round(avg(cast(shr > 0 as double)), 6) as pct_gt0, round(avg(cast(shr >= 5 as double)), 6) as pct_ge5 from aois a left join zone z on z.aoi = a.aoi group by a.aoi")
def share_over_threshold(spark, d):
    return zonal.shares(cells(spark, d), "shr", aois(spark, d))


@query("""select a.aoi, round(sum(w * shr) / sum(w), 6) as mean, round(sum(w), 6) as weight from aois a left join
(select a.aoi, c.shr, greatest(least(c.col + 1.0, a.maxx) - greatest(c.col, a.minx), 0) * greatest(least(c.row + 1.0, a.maxy) - greatest(c.row, a.miny), 0) as w from cells c join (select aoi, minx + 0.25 as minx, maxx - 0.5 as maxx, miny + 0.5 as miny, maxy from aois) a
 on c.col < a.maxx and c.col + 1 > a.minx and c.row < a.maxy and c.row + 1 > a.miny where c.shr is not null) z on z.aoi = a.aoi and z.w > 0 group by a.aoi""")
def weighted_mean(spark, d):
    """Regions moved off the lattice, so that their edges cut cells."""
    moved = aois(spark, d).withColumns({"minx": F.col("minx") + 0.25, "maxx": F.col("maxx") - 0.5, "miny": F.col("miny") + 0.5})
    return zonal.weighted_mean(cells(spark, d, bands=["shr"]), "shr", moved)


@query("select a.aoi, round(avg(case when shr > 0 then shr end), 6) as mean_nonzero, count(case when shr > 0 then shr end) as count_nonzero from aois a left join zone z on z.aoi = a.aoi group by a.aoi")
def nonzero_stats(spark, d):
    return zonal.nonzero(cells(spark, d), "shr", aois(spark, d))


_REPORT = f"""select a.aoi, {_STATS.format(v='z.shr').replace('count(z.shr) as count', 'nullif(count(z.shr), 0) as count')},
round(avg(cast(shr > 0 as double)), 6) as pct_gt0, round(avg(cast(shr >= 5 as double)), 6) as pct_ge5, round(avg(case when shr > 0 then shr end), 6) as mean_nonzero,
case when count(z.aoi) > 0 then count(case when shr > 0 then shr end) end as count_nonzero from aois a left join zone z on z.aoi = a.aoi group by a.aoi"""


@query(f"select r.*, b.tile_id from ({_REPORT}) r left join (select aoi, tile_id from ranked qualify row_number() over (partition by aoi order by area desc, tile_id) = 1) b on b.aoi = r.aoi")
def region_report(spark, d):
    return zonal.region_report(cells(spark, d, bands=["shr"]), "shr", aois(spark, d), grid.best_tile(view(spark, d, "tiles"), aois(spark, d)))


_METRICS = ["count", "mean", "median", "min", "max", "std", "p05", "p25", "p75", "p95"]


@query(" union all ".join(f"select aoi, '{m}' as metric, cast({m} as double) as value from (select a.aoi, {_STATS.format(v='z.shr')} from aois a left join zone z on z.aoi = a.aoi group by a.aoi)" for m in _METRICS))
def report_long(spark, d):
    return zonal.long(zonal_stats(spark, d))


def _hist(source: str, lo: str, hi: str, n: int, closed: bool, key: str = "") -> str:
    k, on = (f"{key}, ", f"h.{key} = b.{key} and ") if key else ("", "")
    keys = f"(select distinct {key} from aois) k, " if key else ""
    return f"""select {'b.' + k if key else ''}b.bin, round({lo} + b.bin * (({hi}) - ({lo})) / {n}.0::double, 6) as bin_left, round({lo} + (b.bin + 0.5::double) * (({hi}) - ({lo})) / {n}.0::double, 6) as bin_center, coalesce(h.n, 0) as count
from (select {k}cast(i as int) as bin from {keys}range({n}) r(i)) b left join
(select {k}least(cast(floor((shr - ({lo})) / ((({hi}) - ({lo})) / {n}.0::double)) as int), {n - 1}) as bin, count(*) as n from {source} where shr >= {lo} and shr {'<=' if closed else '<'} {hi} group by all) h on {on}h.bin = b.bin"""


@query(_hist("cells", "0.0::double", "100.0::double", 50, False))
def hist_fixed_halfopen(spark, d):
    return zonal.histogram(cells(spark, d, bands=["shr"]), "shr", 0.0, 100.0, 50)


@query(_hist("zone", "0.0::double", "100.0::double", 50, True, "aoi"))
def hist_fixed_closed(spark, d):
    return zonal.histogram(grid.zonal_join(cells(spark, d, bands=["shr"]), aois(spark, d)), "shr", 0.0, 100.0, 50, True, ("aoi",), aois(spark, d))


@query(_hist("(select l_extendedprice as shr from pix)", "(select min(l_extendedprice) from pix)", "(select max(l_extendedprice) from pix)", 100, True))
def hist_auto_range(spark, d):
    return zonal.histogram_auto(view(spark, d, "pix").select(F.col("l_extendedprice").alias("shr")), "shr", 100)


# cells over years


@query("select col, row, round(avg(shr), 6) as mean, round(stddev_pop(shr), 6) as std from mos where year between 1995 and 2001 group by col, row")
def cell_stack_mean_std(spark, d):
    return temporal.mosaic(tables.pix_of(spark, d, FIRST, LAST), ["shr"], top()).groupBy("col", "row").agg(*temporal.mean_std(F.col("shr")))


@query("select col, row, trend from feat")
def cell_trend(spark, d):
    return temporal.mosaic(view(spark, d, "pix"), ["shr"], top()).groupBy("col", "row").agg(temporal.trend(F.col("shr")))


@query("select col, row, change from feat")
def cell_change(spark, d):
    return temporal.mosaic(view(spark, d, "pix"), ["shr"], top()).groupBy("col", "row").agg(temporal.change(F.col("shr"), FIRST, LAST))


@query("select col, row, shr, shr >= 5 as ge5, shr >= 10 as ge10, not shr >= 5 as lt5, not shr >= 10 as lt10 from cells")
def threshold_masks(spark, d):
    return temporal.thresholds(cells(spark, d, bands=["shr"]).select("col", "row", "shr"), "shr")


@query("select * from feat")
def feature_cube(spark, d):
    return temporal.feature_cube(tables.pix_of(spark, d, FIRST, LAST), "shr", FIRST, LAST, order=top())


@query("""select col, row, aoi, round(avg(shr), 6) as mean, round(stddev_pop(shr), 6) as std, round(max(shr) filter (where year = 2001) - max(shr) filter (where year = 1995), 6) as change,
round(case when regr_count(shr, year) > 1 then regr_slope(shr, year) end, 6) as trend, cast(max(shr) filter (where year = 2001) >= 5 as int) as ge5, cast(max(shr) filter (where year = 2001) >= 10 as int) as ge10
from (select b.aoi, p.year, p.col, p.row, first(shr order by p.tile_id desc, l_suppkey desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc, l_shipdate desc) filter (where shr is not null) as shr
      from pix p join (select aoi, year, tile_id from ranked qualify row_number() over (partition by aoi, year order by area desc, tile_id) = 1) b on b.year = p.year and b.tile_id % 4 = p.tile_id group by all) group by aoi, col, row""")
def feature_cube_best_tile(spark, d):
    """The cube of each region from its best tile of each year alone (tile numbers folded to those that cells have)."""
    tiles = view(spark, d, "tiles")
    best = grid.best_tile(tiles, aois(spark, d), by_year=True).select("aoi", "year", (F.col("tile_id") % 4).alias("tile_id"))
    return temporal.feature_cube(tables.pix_of(spark, d, FIRST, LAST), "shr", FIRST, LAST, "best_tile", aois=aois(spark, d), best=best, order=top())


_BOX = "(select min(col) c0, max(col) c1, min(row) r0, max(row) r1 from {t})"


def _far(mask: str, source: str, name: str) -> str:
    return f"""select g.col, g.row, round(sqrt(cast(min((g.col - h.col) * (g.col - h.col) + (g.row - h.row) * (g.row - h.row)) as double)) * 10.0, 6) as {name}
from (select cast(i as int) as col, cast(j as int) as row from {_BOX.format(t=source)} b, range(b.c0, b.c1 + 1) x(i), range(b.r0, b.r1 + 1) y(j)) g
left join (select col, row from {source} where {mask}) h on (g.col - h.col) * (g.col - h.col) + (g.row - h.row) * (g.row - h.row) <= {{r}} * {{r}} group by g.col, g.row"""


@query(_far("shr >= 95", "cells", "distance").format(r=255))
def distance_to_mask(spark, d):
    return temporal.distance(temporal.dense(cells(spark, d, bands=["shr"])), F.col("shr") >= 95)


@query(f"""select f.col, f.row, round(c.shr, 6) as cover, f.mean, f.std, f.trend, f.ge5, f.ge10, d5.dist_ge5, d10.dist_ge10
from feat f left join cells c on c.col = f.col and c.row = f.row left join ({_far("ge5 = 1", "feat", "dist_ge5").format(r=255)}) d5 on d5.col = f.col and d5.row = f.row
left join ({_far("ge10 = 1", "feat", "dist_ge10").format(r=255)}) d10 on d10.col = f.col and d10.row = f.row""")
def prior_cube(spark, d):
    return temporal.prior_cube(temporal.mosaic(tables.pix_of(spark, d, FIRST, LAST), ["shr"], top()), "shr", FIRST, LAST)


_CUBE = ["mean", "std", "change", "trend"]
_FIVE = ", ".join(f"round({f}, 6) as {b}_{n}" if n != "count" else f"{f} as {b}_{n}" for b in _CUBE for n, f in (("mean", f"avg({b})"), ("median", f"median({b})"), ("min", f"min({b})"), ("max", f"max({b})"), ("count", f"count({b})")))


@query(f"select a.aoi, {_FIVE.replace('count(', 'nullif(count(*) filter (where c.col is not null), 0) * 0 + count(')} from aois a left join feat c on {_IN} group by a.aoi")
def cube_summary_wide(spark, d):
    return zonal.cube_summary(feature_cube(spark, d), _CUBE, aois(spark, d))


@query(f"select 'all' as region, metric, value from (unpivot (select * replace ({', '.join(f'cast({b}_{n} as double) as {b}_{n}' for b in _CUBE for n in ('mean', 'median', 'min', 'max', 'count'))}) from (select {_FIVE} from feat)) on columns(*) into name metric value value)")
def cube_summary_long(spark, d):
    from cellweave.functions.columns import statistics

    one = feature_cube(spark, d).agg(*[c for b in _CUBE for c in statistics(F.col(b), ("mean", "median", "min", "max", "count"), f"{b}_")])
    return zonal.long(one.withColumn("region", F.lit("all")), "region")


# quality


@query("select a.aoi, count(raw) as n_valid, count(*) filter (where raw < 0) as n_below, count(*) filter (where raw > 100) as n_above from aois a left join pix c on " + _IN + " group by a.aoi")
def qc_range_coverage(spark, d):
    return qc.range_coverage(view(spark, d, "pix").select("col", "row", "raw"), "raw", aois(spark, d))


@query(f"""select a.aoi, {", ".join(x.strip() for x in _STATS.format(v='z.shr').split(", round") [:0])} round(avg(shr), 6) as mean, round(median(shr), 6) as median, round(min(shr), 6) as min, round(max(shr), 6) as max,
round(quantile_cont(shr, 0.05), 6) as p05, round(quantile_cont(shr, 0.25), 6) as p25, round(quantile_cont(shr, 0.75), 6) as p75, round(quantile_cont(shr, 0.95), 6) as p95, round(avg(cast(shr > 0 as double)), 6) as pct_gt0
from aois a left join zone z on z.aoi = a.aoi group by a.aoi""")
def qc_distribution(spark, d):
    return qc.distribution(cells(spark, d, bands=["shr"]), "shr", aois(spark, d))


_SUM = " + ".join(f"coalesce({b}, 0)" for b in BANDS)


@query(f"select a.aoi, round(avg(s), 6) as sum_mean, round(min(s), 6) as sum_min, round(max(s), 6) as sum_max, '{','.join(BANDS)}' as bands_used from aois a left join (select aoi, case when coalesce({', '.join(BANDS)}) is not null then {_SUM} end as s from zone) z on z.aoi = a.aoi group by a.aoi")
def band_sum_check(spark, d):
    return qc.band_sum(cells(spark, d), aois(spark, d)).withColumn("bands_used", F.array_join("bands_used", ","))


_NAMED = [("Annual_Forb", "afg"), ("PFG", "pfg"), ("SHR_cover", "shr"), ("TRE", "tre"), ("Litter", "ltr"), ("BareGround", "bgr")]
_PATTERNS = ", ".join(f"('{k}', '{p}')" for k, ps in qc.PATTERNS for p in ps)


@query(f"""select canonical, first(band order by pos) as band from (unpivot (select {', '.join(f'count({c}) as {n}' for n, c in _NAMED)} from pix) on columns(*) into name band value n) b
join (values {', '.join(f"('{n}', {k})" for k, (n, _) in enumerate(_NAMED))}) o(name, pos) on o.name = b.band join (values {_PATTERNS}) p(canonical, pattern) on contains(lower(band), pattern)
where n > 0 group by canonical qualify count(*) over () = {len(qc.PATTERNS)}""")
def resolve_bands(spark, d):
    """Bands under longer names, as the cells hold them: a band without any valid cell is none."""
    counts = view(spark, d, "pix").agg(*[F.count(c).alias(n) for n, c in _NAMED])
    bands = counts.unpivot([], [n for n, _ in _NAMED], "band", "n").where("n > 0").withColumn("pos", F.array_position(F.array(*[F.lit(n) for n, _ in _NAMED]), F.col("band")))
    return qc.resolve_bands(bands)


@query("select file, count(*) filter (where v <> -32768) as n_usable from raster_cells group by file having count(*) filter (where v <> -32768) > 0")
def usable_files(spark, d):
    return qc.usable_files(view(spark, d, "raster_cells"))


@query("select file, count(*) filter (where v <> -32768) > 0 as usable from raster_cells group by file")
def usable_by_footers(spark, d):
    """A collection in folders by file: which ones hold data, as their footers tell."""
    path = f"{tables.shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    view(spark, d, "raster_cells").select("file", "col", "row", F.col("v").cast("double").alias("v")).repartition("file").write.partitionBy("file").parquet(path)
    return qc.usable_by_footers(spark, path)


@query("select file, min(v) as min_v, round(median(v), 6) as median_v, max(v) as max_v, count(*) filter (where v > 1) as n_above_one from raster_cells where v not in (-32768, -9999) group by file")
def nodata_stats(spark, d):
    return qc.nodata_stats(view(spark, d, "raster_cells"), ["file"])


@query("select file, col, row, case when v not in (-32768, -9999) then v end as v, case when v in (-32768, -9999) then 0 else v end as filled from raster_cells")
def nodata_fill(spark, d):
    return qc.nodata_fill(view(spark, d, "raster_cells").select("file", "col", "row", "v"))


@query("select user_id, value / nullif(user_id % 3, 0) as ratio from events where value / nullif(user_id % 3, 0) is not null")
def finite_filter(spark, d):
    held = table(spark, d, "events").select("user_id", F.try_divide(F.col("value"), F.col("user_id") % 3).alias("ratio"))
    return held.where(finite(F.col("ratio")))


@query("select count(z) as count, round(avg(z), 6) as mean, round(stddev_samp(z), 6) as std, min(z) as min, round(quantile_cont(z, 0.25), 6) as p25, round(quantile_cont(z, 0.5), 6) as p50, round(quantile_cont(z, 0.75), 6) as p75, max(z) as max from cloud")
def describe_column(spark, d):
    return qc.describe(view(spark, d, "cloud"), "z")


# samples


_STRATA = "cast(shr > 0 as int) + cast(shr >= 5 as int)"


@query(f"select col, row, shr, {_STRATA} as strata from cells")
def strata(spark, d):
    return sampling.strata(cells(spark, d, bands=["shr"]).select("col", "row", "shr"), "shr")


_SAMPLE = f"""select aoi, strata, col, row, shr from (select aoi, col, row, shr, {_STRATA} as strata from zone where shr is not null)
qualify row_number() over (partition by aoi, strata order by md5(concat_ws(':', 42, col, row)), col, row) <= 500"""


@query(_SAMPLE)
def stratified_sample(spark, d):
    return sampling.stratified_sample(cells(spark, d, bands=["shr"]), "shr", aois(spark, d))


@query(f"select s.*, f.mean, f.std, f.change, f.trend, f.ge5, f.ge10 from ({_SAMPLE}) s join feat f on f.col = s.col and f.row = s.row where f.mean is not null and f.std is not null and f.change is not null and f.trend is not null and f.ge5 is not null and f.ge10 is not null")
def stratified_features(spark, d):
    return sampling.stratified_features(temporal.mosaic(tables.pix_of(spark, d, FIRST, LAST), ["shr"], top()), "shr", aois(spark, d), FIRST, LAST)


@query("select aoi, pos, point_id, round(x, 6) as x, round(y, 6) as y, cast(floor(x) as int) as col, cast(floor(y) as int) as row from pts")
def random_points(spark, d):
    return sampling.random_points(aois(spark, d)).withColumns({"x": rounded(F.col("x")), "y": rounded(F.col("y"))})


@query("select aoi, pos, point_id, round(x, 6) as x, round(y, 6) as y, col, row, shr from samp")
def sample_at_points(spark, d):
    return samples(spark, d).withColumns({"x": rounded(F.col("x")), "y": rounded(F.col("y"))})


@query(f"select a.aoi, {_STATS.format(v='s.shr').replace('round(stddev_pop(s.shr), 6) as std,', '')}, round(avg(cast(s.shr > 0 as double)), 6) as pct_gt0 from aois a left join samp s on s.aoi = a.aoi group by a.aoi")
def sample_summary(spark, d):
    return sampling.sample_summary(samples(spark, d), "shr", aois(spark, d))


# distribution shift


_PAIRS = "pairs as (select a.aoi as aoi_a, b.aoi as aoi_b from aois a join aois b on a.pos < b.pos)"
_W1 = """select p.aoi_a, p.aoi_b, w.wasserstein from pairs p left join (select aoi_a, aoi_b, round(sum(abs(fa - fb) * (nxt - v)), 6) as wasserstein from (
select aoi_a, aoi_b, v, sum(na) over w / nullif(sum(na) over q, 0) as fa, sum(nb) over w / nullif(sum(nb) over q, 0) as fb, coalesce(lead(v) over w, v) as nxt from (
select p.aoi_a, p.aoi_b, s.shr as v, count(*) filter (where s.aoi = p.aoi_a) as na, count(*) filter (where s.aoi = p.aoi_b) as nb from pairs p join samp s on s.aoi in (p.aoi_a, p.aoi_b) group by all)
window w as (partition by aoi_a, aoi_b order by v), q as (partition by aoi_a, aoi_b)) group by all) w on w.aoi_a = p.aoi_a and w.aoi_b = p.aoi_b"""
_PSI = """select p.aoi_a, p.aoi_b, x.psi from pairs p left join (
with u as (select p.aoi_a, p.aoi_b, s.aoi, s.shr as v from pairs p join samp s on s.aoi in (p.aoi_a, p.aoi_b)),
e as (select aoi_a, aoi_b, list_sort(list_distinct(list_transform(quantile_cont(v, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1]), lambda q: round(q, 9)))) as edges,
      count(*) filter (where aoi = aoi_a) as ta, count(*) filter (where aoi = aoi_b) as tb from u group by all),
b as (select u.aoi_a, u.aoi_b, least(len(list_filter(edges, lambda q: q <= v)), len(edges) - 1) - 1 as bin, count(*) filter (where aoi = u.aoi_a) as na, count(*) filter (where aoi = u.aoi_b) as nb
      from u join e using (aoi_a, aoi_b) where v between edges[1] and edges[len(edges)] group by all),
d as (select aoi_a, aoi_b, unnest(range(0, len(edges) - 1)) as bin from e where len(edges) >= 3),
f as (select aoi_a, aoi_b, coalesce(na, 0) as na, coalesce(nb, 0) as nb from d left join b using (aoi_a, aoi_b, bin)),
s as (select aoi_a, aoi_b, greatest(na / greatest(sum(na) over (partition by aoi_a, aoi_b), 1), 1e-6::double) as pa, greatest(nb / greatest(sum(nb) over (partition by aoi_a, aoi_b), 1), 1e-6::double) as pb from f),
t as (select aoi_a, aoi_b, sum((pa - pb) * ln(pa / pb)) as raw from s group by all)
select e.aoi_a, e.aoi_b, round(case when ta > 0 and tb > 0 then coalesce(raw, 0.0) end, 6) as psi from e left join t using (aoi_a, aoi_b)) x on x.aoi_a = p.aoi_a and x.aoi_b = p.aoi_b"""


@query(f"select * from (with {_PAIRS} {_W1})")
def shift_wasserstein(spark, d):
    return shift.wasserstein(samples(spark, d), "shr", aois(spark, d))


@query(f"select * from (with {_PAIRS} {_PSI})")
def shift_psi(spark, d):
    return shift.psi(samples(spark, d), "shr", aois(spark, d))


@query(f"select w.*, q.psi from (with {_PAIRS} {_W1}) w join (with {_PAIRS} {_PSI}) q on q.aoi_a = w.aoi_a and q.aoi_b = w.aoi_b")
def shift_table(spark, d):
    return shift.shift_table(samples(spark, d), "shr", aois(spark, d))


@query(_hist("samp", "0.0::double", "100.0::double", 50, True, "aoi"))
def comparison_histogram(spark, d):
    return shift.compare(cells(spark, d, bands=["shr"]), "shr", aois(spark, d)).histogram


# grids


_COARSE = "(select distinct cast(col // 2 as int) as col, cast(row // 2 as int) as row from cells)"


@query(f"""select col, row, round(sum(w * shr) / nullif(sum(w), 0), 6) as shr from (
select t.col, t.row, s.shr, case when s.shr is not null then (1 - abs(t.fx - (t.c0 + i))) * (1 - abs(t.fy - (t.r0 + j))) end as w
from (select col, row, (col + 0.5::double) * 2 - 0.5::double as fx, (row + 0.5::double) * 2 - 0.5::double as fy, cast(floor((col + 0.5) * 2 - 0.5) as int) as c0, cast(floor((row + 0.5) * 2 - 0.5) as int) as r0 from {_COARSE}) t,
range(2) x(i), range(2) y(j) left join cells s on s.col = t.c0 + i and s.row = t.r0 + j) group by col, row""")
def resample_bilinear(spark, d):
    source = cells(spark, d, bands=["shr"])
    return grid.resample_bilinear(source, "shr", grid.coarse_grid(source, 2), 2.0)


@query(f"select t.col, t.row, s.tre from {_COARSE} t left join cells s on s.col = floor((t.col + 0.5) * 2) and s.row = floor((t.row + 0.5) * 2)")
def resample_nearest(spark, d):
    source = cells(spark, d)
    return grid.resample_nearest(source, "tre", grid.coarse_grid(source, 2), 2.0)


@query("select cast(col // 5 as int) as col, cast(row // 5 as int) as row, shr from cells where col % 5 = 2 and row % 5 = 2")
def decimate(spark, d):
    return grid.decimate(cells(spark, d, bands=["shr"]).select("col", "row", "shr"))


@query("select cast(col // k as int) as col, cast(row // k as int) as row, k as factor, round(avg(shr), 6) as shr from cells, (select cast(greatest(1, ceil(sqrt(count(shr) / 150.0::double))) as int) as k from cells) group by all")
def coarsen_to_budget(spark, d):
    return grid.coarsen_to_budget(cells(spark, d, bands=["shr"]), "shr", 150)


@query("select cast(col >> k as int) as col, cast(row >> k as int) as row, round(avg(shr), 6) as shr, cast(1 << k as int) as factor from cells, (select min(k) as k from (select k, count(distinct (col >> k, row >> k)) as n from cells, range(12) r(k) where shr is not null group by k) where n <= 150) where shr is not null group by all")
def overview_within_budget(spark, d):
    """The finest overview of at most 150 blocks."""
    return pyramid.Pyramid.build(cells(spark, d, bands=["shr"]), "shr").within(150, "shr")


@query(f"""select t.col, t.row, b.shr, b.afg, s.tre, s.ltr from {_COARSE} t join (
select col, row, round(sum(w * shr) / nullif(sum(case when shr is not null then w end), 0), 6) as shr, round(sum(w * afg) / nullif(sum(case when afg is not null then w end), 0), 6) as afg from (
select t.col, t.row, s.shr, s.afg, (1 - abs(t.fx - (t.c0 + i))) * (1 - abs(t.fy - (t.r0 + j))) as w
from (select col, row, (col + 0.5::double) * 2 - 0.5::double as fx, (row + 0.5::double) * 2 - 0.5::double as fy, cast(floor((col + 0.5) * 2 - 0.5) as int) as c0, cast(floor((row + 0.5) * 2 - 0.5) as int) as r0 from {_COARSE}) t,
range(2) x(i), range(2) y(j) left join cells s on s.col = t.c0 + i and s.row = t.r0 + j) group by col, row) b on b.col = t.col and b.row = t.row
left join cells s on s.col = floor((t.col + 0.5) * 2) and s.row = floor((t.row + 0.5) * 2)""")
def resample_bands(spark, d):
    """Two continuous and two categorical bands on a grid half as fine, together."""
    source = tables.written(cells(spark, d), "cells")
    return resample.resample(source, ["shr", "afg"], ["tre", "ltr"], grid.coarse_grid(source, 2), 2.0, block=16)


_LAT = "(miny + maxy) / 2"
_LON = "(minx + maxx) / 2"


@query(f"select tile_id, year, round({_LON} - 2.5::double / (111.32::double * cos(radians({_LAT}))), 6) as minx, round({_LON} + 2.5::double / (111.32::double * cos(radians({_LAT}))), 6) as maxx, round({_LAT} - 2.5::double / 111.32::double, 6) as miny, round({_LAT} + 2.5::double / 111.32::double, 6) as maxy from tiles")
def bbox_buffer(spark, d):
    return grid.bbox_buffer(view(spark, d, "tiles"))


@query(f"select tile_id, year, round(minx + 10.0::double / (111.32::double * cos(radians({_LAT}))), 6) as minx, round(maxx + 10.0::double / (111.32::double * cos(radians({_LAT}))), 6) as maxx, miny, maxy from tiles")
def bbox_shift(spark, d):
    return grid.bbox_shift(view(spark, d, "tiles"))


_Y = "case when abs({y}) <= 85.06 then round(ln(tan(pi() / 4 + radians({y}) / 2)) * 6378137.0::double, 6) end"


@query(f"select tile_id, year, round(radians(minx) * 6378137.0::double, 6) as minx, {_Y.format(y='miny')} as miny, round(radians(maxx) * 6378137.0::double, 6) as maxx, {_Y.format(y='maxy')} as maxy from tiles")
def to_web_mercator(spark, d):
    return grid.to_web_mercator(view(spark, d, "tiles"))

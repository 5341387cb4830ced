"""Sources: Parquet tables, partitioned cell collections, cell views over the driver's tables, GeoJSON layers and folders of files."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: the surrogate views, in SQL that Spark and DuckDB both run
VIEWS = {
    "pix": """select l_suppkey % 4 as tile_id, cast(year(l_shipdate) as int) as year,
       cast(l_partkey % 50 as int) as col, cast(floor(l_partkey / 50) as int) as row,
       l_discount*100 as afg, l_tax*100 as pfg,
       case when l_linenumber=7 then null else greatest(l_quantity*2.5-25, 0) end as shr,
       cast((l_linenumber % 3)*2 as double) as tre, cast(l_linenumber as double) as ltr,
       100-l_quantity as bgr, l_quantity*3-25 as raw,
       l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate
from lineitem""",
    "aois": """select concat('aoi', r_regionkey) as aoi, cast(r_regionkey as int) as pos,
       cast(r_regionkey*9 as double) as minx, cast(r_regionkey*9+12 as double) as maxx,
       cast(0 as double) as miny, cast(case when r_regionkey=4 then 0 else 4 end as double) as maxy
from region""",
    "tiles": """select s_suppkey as tile_id, 1995+cast(s_suppkey % 7 as int) as year,
       cast((s_suppkey % 10)*45 as double)/10 as minx, cast((s_suppkey % 10)*45+60 as double)/10 as maxx,
       cast(cast(floor(s_suppkey/10) as int) as double)/2 as miny,
       cast(cast(floor(s_suppkey/10) as int) as double)/2+3 as maxy
from supplier""",
    "raster_cells": """select concat('f', l_suppkey % 10) as file, 1 as band,
       cast(l_partkey % 50 as int) as col, cast(floor(l_partkey/50) as int) as row,
       case when l_suppkey % 10 in (3,6,9) then cast(-32768 as double)
            when l_linenumber=7 then cast(-9999 as double) else l_quantity/40 end as v
from lineitem""",
    "plots": """select concat('plot', s_suppkey) as name, case when s_suppkey % 3 = 0 then 'MultiPolygon' else 'Polygon' end as geometry_type,
       concat(case when s_suppkey % 3 = 0 then '[' else '' end, '[[[', x, ',', y, '],[', x + 6, ',', y + 1, '],[', x + 7, ',', y + 4, '],[', x + 1, ',', y + cast(3.5 as double), '],[', x, ',', y, ']]',
              case when s_suppkey % 2 = 0 then concat(',[[', x + 2, ',', y + cast(1.5 as double), '],[', x + cast(3.5 as double), ',', y + 3, '],[', x + 4, ',', y + 2, '],[', x + 2, ',', y + cast(1.5 as double), ']]') else '' end, ']',
              case when s_suppkey % 3 = 0 then concat(',[[[', x + 8, ',', y, '],[', x + 10, ',', y, '],[', x + 9, ',', y + cast(2.5 as double), '],[', x + 8, ',', y, ']]]]') else '' end) as coordinates
from (select s_suppkey, cast(s_suppkey % 9 as double) * 5 as x, cast(floor(s_suppkey / 9) as double) % 12 as y from supplier)""",
    "cloud": """select event_type as file, cast(user_id as double) as x, cast(event_id as double) as y,
       value as z, cast(event_id % 6 as int) as classification
from events""",
}
_OVER = {"pix": "lineitem", "aois": "region", "tiles": "supplier", "raster_cells": "lineitem", "plots": "supplier", "cloud": "events"}

GEOJSON = T.StructType([
    T.StructField("crs", T.StructType([T.StructField("properties", T.StructType([T.StructField("name", T.StringType())]))])),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
        T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    ]))),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the cell, tile, region and point tables over the driver's tables."""
    return spark.sql(VIEWS[name].replace(f"from {_OVER[name]}", "from {src}"), src=table(spark, sf_dir, _OVER[name]))


#: bytes of an Arrow batch, about: rows of packed cells are large
BATCH_BYTES = 64 << 20


def ship(spark: SparkSession) -> None:
    """Python workers get the folder of this package on their path, and batches of bounded bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH")]))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; without one a local session gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: cells a side of the blocks in a collection's folders
AREA = 4096
#: so many squares of regions are sent to every executor
SQUARES = 1 << 20


def morton(bx: Column, by: Column, bits: int = 20) -> Column:
    """Both numbers' bits in turn: blocks near each other mostly have numbers near each other. Negative numbers take part by their lowest bits."""
    # the binary digits of a number read in base four stand at every second place
    spread = lambda c: F.conv(F.bin(c.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))), 4, 10).cast("long")
    return spread(bx) + 2 * spread(by)


def _area(col: Column, row: Column, area: int) -> Column:
    return morton(F.floor(col / area), F.floor(row / area))


def write_cells(cells: DataFrame, path: str, block: int = 256, area: int | None = None) -> None:
    """A collection of yearly cells as Parquet: a folder for each year, in it cells in the order of their blocks.

    Readers prune years by folder and regions by the row groups' ranges of col and row. With ``area``, a year's
    folder has one for each square of so many cells a side (``area``, its Morton number), which regions prune too.
    """
    folders = ["year"] if area is None else ["year", "area"]
    laid = cells if area is None else cells.withColumn("area", _area(F.col("col"), F.col("row"), area))
    laid = laid.withColumns({"bx": F.expr(f"col div {block}"), "by": F.expr(f"row div {block}")})
    laid.repartitionByRange(*folders, "bx", "by").sortWithinPartitions(*folders, "bx", "by").drop("bx", "by").write.mode("overwrite").partitionBy(*folders).parquet(path)


def read_cells(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    """A collection, or one year of it: only that year's folder is listed and read."""
    cells = spark.read.parquet(path)
    return cells if year is None else cells.where(F.col("year") == year)


def cells_near(cells: DataFrame, aois: DataFrame, area: int = AREA, scale: float = 1.0) -> DataFrame:
    """The cells of a collection written with ``area`` that lie in a square of some region.

    The regions' squares prune the collection's folders when the query runs; the plan has no list of them.
    """
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / scale / area), F.floor(F.col(hi) / scale / area))
    squares = aois.where("minx < maxx and miny < maxy").select(F.explode(span("minx", "maxx")).alias("ax"), "miny", "maxy").select("ax", F.explode(span("miny", "maxy")).alias("ay"))
    squares = squares.select(morton(F.col("ax"), F.col("ay")).alias("area")).distinct()
    # Spark prunes by what it broadcasts; past that size the join alone thins the cells
    sent = F.broadcast(squares) if squares.limit(SQUARES + 1).count() <= SQUARES else squares
    return cells.join(sent, "area", "left_semi")


def footer_bounds(spark: SparkSession, path: str, keys: list[str], v: str = "v") -> DataFrame:
    """The aggregation that ``footers`` runs."""
    return spark.read.parquet(path).groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))


def footers(spark: SparkSession, path: str, keys: list[str], v: str = "v") -> DataFrame:
    """``(keys, n, lo, hi)`` of a collection in folders by ``keys``: rows, least and greatest value, as the files' footers have them.

    The aggregation is pushed into the Parquet reader, which reads no rows. Footers state no bounds for values that are
    all null or hold NaN; with such a file in it, a collection's values are read instead.
    """
    conf, was = spark.conf, {}
    for name, value in (("spark.sql.sources.useV1SourceList", "avro,csv,json,kafka,orc,text"), ("spark.sql.parquet.aggregatePushdown", "true")):
        was[name] = conf.get(name)
        conf.set(name, value)
    try:
        return written(footer_bounds(spark, path, keys, v), "footers")  # while the settings hold
    except Py4JJavaError as e:
        if "No min/max found" not in str(e):
            raise
    finally:
        for name, value in was.items():
            conf.set(name, value)
    return footer_bounds(spark, path, keys, v)


def pix_of(spark: SparkSession, sf_dir: str, first: int, last: int) -> DataFrame:
    """The cells of some years; the range of dates reaches the Parquet scan."""
    dated = F.col("l_shipdate").between(F.lit(f"{first}-01-01").cast("timestamp"), F.lit(f"{last}-12-31 23:59:59.999999").cast("timestamp"))
    return view(spark, sf_dir, "pix").where(dated & F.col("year").between(first, last))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(file, bytes, modified)``: a folder's files as a work list; their content isn't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(crs, geometry_type, coordinates, properties)``: a row for each feature.

    Coordinates stay JSON text, so that files that mix geometry types read alike; ``vector.with_parts`` reads them.
    The coordinate system is that of the file, or EPSG:4326. A file is one collection, or with ``lines`` has one
    on each line, so that many tasks share a large file.
    """
    files = spark.read.schema(GEOJSON).option("multiLine", not lines).json(path)
    return files.select(F.coalesce("crs.properties.name", F.lit("EPSG:4326")).alias("crs"), F.explode("features").alias("f")).select(
        "crs", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends there, and later steps don't repeat its work."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def inventory(cells: DataFrame, file: str | None = "file") -> DataFrame:
    """``(file, n_cells)`` of the files that cells came from: those that a column names, or with None those that Spark read."""
    name = F.col(file) if file else F.col("_metadata.file_name")
    return cells.groupBy(name.alias("file")).agg(F.count("*").alias("n_cells"))


def first_row(df: DataFrame, key: list[str]) -> DataFrame:
    """``(field, value)``: the fields of the table's first row by key, as text."""
    return df.orderBy(*key).limit(1).select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "field", "value")


def preview(df: DataFrame, key: list[str], n: int = 5) -> DataFrame:
    """The table's first rows by key, each with the numbers of rows and columns of the whole table."""
    size = df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
    return df.orderBy(*key).limit(n).crossJoin(F.broadcast(size))

"""Quality checks: nodata, finiteness, ranges, band names and band sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.columns import finite, rounded, sound, statistics
from cellweave.operators.quantiles import with_quantiles
from cellweave.operators.zonal import zonal
from cellweave.sources import tables

NODATA = (-32768.0, -9999.0)
#: fixed values: the six cover types in order, and the lower-case name parts that mean each
#: ("shr" also meets the longer word for its type, which is left out)
PATTERNS = [
    ("AFG", ["afg", "annual_forb", "annual forb", "annual grass", "annual_forbs", "annual_grasses"]),
    ("PFG", ["pfg", "perennial_forb", "perennial forb", "perennial grass", "perennial_forbs", "perennial_grasses"]),
    ("SHR", ["shr"]),
    ("TRE", ["tre", "tree"]),
    ("LTR", ["ltr", "litter"]),
    ("BGR", ["bg", "bare", "bareground", "bare_ground"]),
]
#: fixed values: the bands of a sum besides bare ground, and the two names of that, the first one preferred
COVER, BARE = ["AFG", "PFG", "SHR", "TRE", "LTR"], ["BG", "BGR"]


def range_coverage(cells: DataFrame, band: str, aois: DataFrame, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """Finite cells and those out of range by region; 0 where a region has none."""
    v = sound(F.col(band))
    made = zonal(cells, aois, [F.count(v).alias("n_valid"), F.count_if(v < lo).alias("n_below"), F.count_if(v > hi).alias("n_above")])
    return made.na.fill(0, ["n_valid", "n_below", "n_above"])


def distribution(cells: DataFrame, band: str, aois: DataFrame, accuracy: int | None = None) -> DataFrame:
    return zonal(cells, aois, statistics(F.col(band), ("mean", "median", "min", "max", "p05", "p25", "p75", "p95", "pct_gt0"), accuracy=accuracy))


def cover_bands(columns: list[str]) -> list[str]:
    """The columns of the six cover types, bare ground under either of its names; letter case doesn't matter. ValueError if one is missing."""
    known = {c.upper(): c for c in reversed(columns)}
    bare = [b for b in BARE if b in known]
    missing = [b for b in COVER if b not in known]
    if not bare or missing:
        raise ValueError(f"no {' or '.join(BARE)} band" if not bare else f"no band {', '.join(missing)}")
    return [known[b] for b in [*COVER, bare[0]]]


def band_sum(cells: DataFrame, aois: DataFrame, bands: list[str] | None = None) -> DataFrame:
    """``(aoi, sum_mean, sum_min, sum_max, bands_used)``: the sum of the bands, by default of ``cover_bands``, by region;
    a band that isn't finite counts 0, a cell without any finite band has no sum. ``bands_used`` is an array of names."""
    names = cover_bands(cells.columns) if bands is None else list(bands)
    bands = [sound(F.col(b)) for b in names]
    total = sum((F.coalesce(b, F.lit(0.0)) for b in bands), F.lit(0.0))
    v = F.when(F.coalesce(*bands).isNotNull(), total)
    made = zonal(cells, aois, [rounded(F.avg(v)).alias("sum_mean"), rounded(F.min(v)).alias("sum_min"), rounded(F.max(v)).alias("sum_max")])
    return made.withColumn("bands_used", F.array(*map(F.lit, names)))


def resolve_bands(bands: DataFrame) -> DataFrame:
    """``(canonical, band)`` from ``bands(pos, band)``: the first band, by pos, whose name holds a pattern; all six or none."""
    patterns = bands.sparkSession.createDataFrame([(k, p) for k, ps in PATTERNS for p in ps], "canonical string, pattern string")
    found = bands.join(F.broadcast(patterns), F.lower("band").contains(F.col("pattern"))).groupBy("canonical").agg(F.min_by("band", "pos").alias("band"))
    whole = found.agg(F.count("*").alias("n")).where(F.col("n") == len(PATTERNS))
    return found.join(F.broadcast(whole)).drop("n")


def usable_files(cells: DataFrame, nodata: float = NODATA[0]) -> DataFrame:
    """Files with finite values besides nodata, and how many."""
    return cells.groupBy("file").agg(F.count_if(sound(F.col("v")) != nodata).alias("n_usable")).where("n_usable > 0")


def usable_by_footers(spark: SparkSession, path: str, nodata: float = NODATA[0], key: str = "file") -> DataFrame:
    """``(file, usable)`` of a collection in folders by file, from footers where they tell.

    A file whose least or greatest value is another number than nodata is usable, one whose bounds both are nodata is not;
    rows are read only of files whose footers state no number.
    """
    bounds = tables.footers(spark, path, [key])
    told = F.when(finite(F.col("lo")) & finite(F.col("hi")), (F.col("lo") != nodata) | (F.col("hi") != nodata))
    known = tables.written(bounds.select(key, told.alias("usable")), "footers")
    if known.where("usable is null").isEmpty():
        return known
    open_files = known.where("usable is null").select(F.col(key).alias("of"))
    rows = spark.read.parquet(path).join(open_files, F.col(key) == F.col("of"), "left_semi")
    read = rows.groupBy(key).agg((F.count_if(sound(F.col("v")) != nodata) > 0).alias("usable"))
    return known.where("usable is not null").unionByName(read)


def without_nodata(cells: DataFrame, nodata: tuple[float, ...] = NODATA) -> DataFrame:
    return cells.where(F.col("v").isNotNull() & ~F.col("v").isin(*nodata))


def nodata_stats(cells: DataFrame, keys: list[str], accuracy: int | None = None) -> DataFrame:
    """Minimum, median, maximum and the count above 1 of what is valid and finite.

    The median is exact, by rounds of bins, or with an ``accuracy`` from a sketch; neither holds a group's values.
    """
    held = finite_only(without_nodata(cells), "v")
    plain = [F.min("v").alias("min_v"), F.max("v").alias("max_v"), F.count_if(F.col("v") > 1).alias("n_above_one")]
    if accuracy is not None:
        made = held.groupBy(*keys).agg(*plain, rounded(F.percentile_approx("v", 0.5, accuracy)).alias("median_v"))
    else:
        made = with_quantiles(held, held.groupBy(*keys).agg(*plain), "v", {"median_v": 0.5}, keys)
    return made.select(*keys, "min_v", "median_v", "max_v", "n_above_one")


def nodata_fill(cells: DataFrame, fill: float = 0.0, nodata: tuple[float, ...] = NODATA) -> DataFrame:
    """The filled value in a column of its own; v keeps null where data are missing."""
    missing = F.col("v").isin(*nodata)
    return cells.withColumn("filled", F.when(missing, fill).otherwise(F.col("v"))).withColumn("v", F.when(~missing, F.col("v")))


def finite_only(df: DataFrame, v: str) -> DataFrame:
    return df.where(finite(F.col(v)))


def describe(df: DataFrame, v: str, accuracy: int | None = None) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum of the finite values, as numbers.

    Quartiles are exact, by rounds of bins, or with an ``accuracy`` from a sketch; neither holds the column's values.
    """
    c, points = F.col(v), {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    held = finite_only(df, v).withColumn("all", F.lit(1))
    plain = [F.count(c).alias("count"), rounded(F.avg(c)).alias("mean"), rounded(F.stddev_samp(c)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")]
    if accuracy is not None:
        made = held.agg(*plain, *[rounded(F.percentile_approx(c, p, accuracy)).alias(k) for k, p in points.items()])
    else:
        made = with_quantiles(held, held.agg(*plain).withColumn("all", F.lit(1)), v, points, ["all"])
    return made.select("count", "mean", "std", "min", *points, "max")


def elevation(cloud: DataFrame) -> DataFrame:
    """Points, dimensions and elevation range of each file of a cloud."""
    n = len([c for c in cloud.columns if c != "file"])
    return cloud.groupBy("file").agg(F.count("*").alias("n_points"), F.min("z").alias("min_z"), F.max("z").alias("max_z")).withColumn("n_dimensions", F.lit(n))


def dimensions(cloud: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """``(position, dimension)``: the names of a cloud's dimensions in order."""
    names = [c for c in cloud.columns if c not in keys]
    return cloud.limit(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("position", "dimension"))

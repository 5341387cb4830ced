"""Statistics, shares and histograms over regions, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.columns import finite, rounded, share, sound, statistics
from cellweave.operators.grid import sent_if_few, zonal_join, zonal_overlap
from cellweave.operators.vector import polygon_join

ALL = ("count", "mean", "median", "min", "max", "std", "p05", "p25", "p75", "p95")


def zonal(cells: DataFrame, aois: DataFrame, aggregates: list, keys: tuple[str, ...] = ("aoi",)) -> DataFrame:
    """Aggregates by region; regions without cells are kept, with null statistics. Regions are boxes, or polygons if they have ``parts``."""
    join = polygon_join if "parts" in aois.columns else zonal_join
    found = join(cells, aois).groupBy(*keys).agg(*aggregates)
    return aois.select(*keys).join(found, list(keys), "left")


def zonal_stats(cells: DataFrame, band: str, aois: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Statistics by region; with an ``accuracy``, quantiles come from sketches of bounded size."""
    return zonal(cells, aois, statistics(F.col(band), ALL, accuracy=accuracy)).withColumn("count", F.coalesce("count", F.lit(0)))


def weighted_mean(cells: DataFrame, band: str, aois: DataFrame, scale: float = 1.0) -> DataFrame:
    """``(aoi, mean, weight)``: the mean of finite cells by the share of each that lies in the region, and the summed shares."""
    held = zonal_overlap(cells.where(finite(F.col(band))), aois, scale)
    made = held.groupBy("aoi").agg(rounded(F.sum(F.col("weight") * F.col(band)) / F.sum("weight")).alias("mean"), rounded(F.sum("weight")).alias("weight"))
    return aois.select("aoi").join(made, "aoi", "left")


def shares(cells: DataFrame, band: str, aois: DataFrame) -> DataFrame:
    """Fractions of finite cells above 0 and from 5 on."""
    v = sound(F.col(band))
    return zonal(cells, aois, [rounded(share(v > 0)).alias("pct_gt0"), rounded(share(v >= 5)).alias("pct_ge5")])


def nonzero(cells: DataFrame, band: str, aois: DataFrame) -> DataFrame:
    v = F.when(sound(F.col(band)) > 0, F.col(band))
    return zonal(cells, aois, [rounded(F.avg(v)).alias("mean_nonzero"), F.count(v).alias("count_nonzero")]).withColumn("count_nonzero", F.coalesce("count_nonzero", F.lit(0)))


def region_report(cells: DataFrame, band: str, aois: DataFrame, best: DataFrame, accuracy: int | None = None) -> DataFrame:
    """All of the above and the region's best tile, from one scan."""
    v = sound(F.col(band))
    some = F.when(v > 0, v)
    made = zonal(cells, aois, [*statistics(v, ALL, accuracy=accuracy), rounded(share(v > 0)).alias("pct_gt0"), rounded(share(v >= 5)).alias("pct_ge5"), rounded(F.avg(some)).alias("mean_nonzero"), F.count(some).alias("count_nonzero")])
    return made.join(sent_if_few(best.select("aoi", "tile_id"), aois), "aoi", "left")


def long(wide: DataFrame, key: str = "aoi") -> DataFrame:
    """Every other column as (key, metric, value) rows, sorted."""
    names = [c for c in wide.columns if c != key]
    held = wide.select(key, *[F.col(c).cast("double").alias(c) for c in names])
    return held.unpivot(key, names, "metric", "value").orderBy(key, "metric")


def cube_summary(cube: DataFrame, bands: list[str], aois: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Mean, median, min, max and count of each band in each region, as band_stat columns."""
    return zonal(cube, aois, [c for b in bands for c in statistics(F.col(b), ("mean", "median", "min", "max", "count"), f"{b}_", accuracy)])


def histogram(values: DataFrame, v: str, lo: float, hi: float, n: int, closed: bool = False, keys: tuple[str, ...] = (), groups: DataFrame | None = None) -> DataFrame:
    """``(keys, bin, bin_left, bin_center, count)`` with all bins, also empty ones, of each of ``groups`` (regions,
    say), also those without values; without ``groups`` of the keys that values have.

    Half-open [lo, hi), or with v = hi counted in the last bin (closed).
    """
    width = (hi - lo) / n
    c = sound(F.col(v))
    inside = (c >= lo) & ((c <= hi) if closed else (c < hi))
    counts = values.where(inside).groupBy(*keys, F.least(F.floor((c - lo) / width).cast("int"), F.lit(n - 1)).alias("bin")).agg(F.count("*").alias("k"))
    bins = values.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    if keys:
        bins = (values if groups is None else groups).select(*keys).distinct().join(F.broadcast(bins))
    left = F.lit(lo) + F.col("bin") * width
    return bins.join(counts, [*keys, "bin"], "left").select(*keys, "bin", rounded(left).alias("bin_left"), rounded(left + width / 2).alias("bin_center"), F.coalesce("k", F.lit(0)).alias("count"))


def histogram_auto(values: DataFrame, v: str, n: int) -> DataFrame:
    """The closed histogram over the data's own range; the range comes from the same plan. Without spread, one bin holds all."""
    c = sound(F.col(v))
    span = values.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).where("lo is not null")
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / n).otherwise(F.lit(1.0))
    counts = values.where(c.isNotNull()).join(F.broadcast(span)).groupBy(F.least(F.floor((c - F.col("lo")) / width).cast("int"), F.lit(n - 1)).alias("bin")).agg(F.count("*").alias("k"))
    bins = values.sparkSession.range(n).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(span.withColumn("width", width)))
    return bins.join(counts, "bin", "left").select("bin", rounded(F.col("lo") + F.col("bin") * F.col("width")).alias("bin_left"), rounded(F.col("lo") + (F.col("bin") + 0.5) * F.col("width")).alias("bin_center"), F.coalesce("k", F.lit(0)).alias("count"))

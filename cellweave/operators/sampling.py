"""Reproducible samples: order comes from MD5 hashes, so it is the same in every partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.functions.columns import QUANTILES, finite, statistics, strata_of, unit_hash
from cellweave.operators import temporal
from cellweave.operators.grid import few_regions, sent_if_few, zonal_join
from cellweave.operators.quantiles import with_quantiles
from cellweave.sources.tables import written


def strata(cells: DataFrame, v: str, threshold: float = 5.0) -> DataFrame:
    return cells.withColumn("strata", strata_of(F.col(v), threshold))


def stratified_sample(cells: DataFrame, v: str, aois: DataFrame, seed: int = 42, n: int = 500, by_class: dict[int, int] | None = None, bins: int = 1 << 14, bands: tuple[str, ...] = ()) -> DataFrame:
    """``(aoi, strata, col, row, v, bands)``: up to n cells of each class in each region, or as many as by_class says.

    Cells are counted by bins of their hash first; of a class only the bins up to the one that fills its sample
    are put in order, so no class is sorted whole.
    """
    held = zonal_join(strata(cells, v).where("strata is not null").select("col", "row", v, "strata", *bands), aois)
    want = F.lit(n)
    if by_class:
        want = F.coalesce(F.create_map(*[F.lit(x) for pair in by_class.items() for x in pair])[F.col("strata")], want)
    keyed = held.select("aoi", "strata", "col", "row", v, *bands, F.md5(F.concat_ws(":", F.lit(seed), "col", "row")).alias("h"), want.alias("want"))
    keyed = keyed.withColumn("bin", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 4294967296.0 * bins).cast("int"))
    counts = keyed.groupBy("aoi", "strata", "want", "bin").agg(F.count("*").alias("m"))
    below = F.sum("m").over(W.partitionBy("aoi", "strata").orderBy("bin")) - F.col("m")
    last = counts.withColumn("below", below).where("below < want").groupBy("aoi", "strata").agg(F.max("bin").alias("last"))
    some = keyed.join(sent_if_few(last, aois), ["aoi", "strata"]).where("bin <= last")
    return some.withColumn("k", F.row_number().over(W.partitionBy("aoi", "strata").orderBy("h", "col", "row"))).where("k <= want").select("aoi", "strata", "col", "row", v, *bands)


def stratified_features(years: DataFrame, v: str, aois: DataFrame, first: int, last: int, seed: int = 42, n: int = 500, by_class: dict[int, int] | None = None) -> DataFrame:
    """``(aoi, strata, col, row, v, mean, std, change, trend, ge5, ge10)``: a stratified sample of the last year's cells
    with their features over all years of ``years(year, col, row, v)``; cells that lack a feature leave the sample, and others don't replace them.

    The cube with the last year's value is made in one aggregation and written, and the sample carries its bands
    along: tiles are merged once, and no join brings features back.
    """
    cube = temporal.change_cube(years, v, first, last, value=True)
    bands = tuple(c for c in cube.columns if c not in ("col", "row", v))
    return stratified_sample(written(cube, "cube"), v, aois, seed, n, by_class, bands=bands).dropna("any", subset=list(bands))


def random_points(aois: DataFrame, n: int = 5000, seed: int = 42, scale: float = 1.0) -> DataFrame:
    """``(aoi, point_id, x, y, col, row)``: n points in each region that has an area; generated on executors."""
    ids = aois.sparkSession.range(n).withColumnRenamed("id", "point_id")
    at = lambda axis: unit_hash(F.concat_ws(":", F.lit(seed), F.lit(axis), "point_id"))
    x = F.col("minx") + at("x") * (F.col("maxx") - F.col("minx"))
    y = F.col("miny") + at("y") * (F.col("maxy") - F.col("miny"))
    # many regions are dealt out, and each makes its own points
    held = aois.where("maxx > minx and maxy > miny")
    laid = (ids.join(F.broadcast(held)) if few_regions(aois) else held.repartition("aoi").withColumn("point_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))).select("aoi", "pos", "point_id", x.alias("x"), y.alias("y"))
    return laid.withColumns({"col": F.floor(F.col("x") / scale).cast("int"), "row": F.floor(F.col("y") / scale).cast("int")})


def at_points(points: DataFrame, cells: DataFrame, bands: list[str]) -> DataFrame:
    """Points with the bands of their cell; points where any band is null go."""
    return points.join(cells.select("col", "row", *bands), ["col", "row"]).dropna("any", subset=bands)


def sample_summary(samples: DataFrame, v: str, aois: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Statistics of the finite sampled values by region; regions without any have n = 0 and nulls.

    Quantiles are exact, by rounds of bins, or with an ``accuracy`` from sketches; neither holds a region's values.
    """
    held = samples.where(finite(F.col(v)))
    names = ("count", "mean", "median", "p05", "p25", "p75", "p95", "min", "max", "pct_gt0")
    if accuracy is not None:
        made = held.groupBy("aoi").agg(*statistics(F.col(v), names, accuracy=accuracy))
    else:
        points = {n: QUANTILES[n] for n in names if n in QUANTILES}
        held = written(held.select("aoi", v), "samples")
        made = with_quantiles(held, held.groupBy("aoi").agg(*statistics(F.col(v), tuple(n for n in names if n not in points))), v, points, ["aoi"])
    return aois.select("aoi").join(made.select("aoi", *names), "aoi", "left").withColumn("count", F.coalesce("count", F.lit(0)))

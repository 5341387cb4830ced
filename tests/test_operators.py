"""Hand-computed small frames and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions.columns import finite, strata_of
from cellweave.operators import grid, qc, sampling, shift, temporal, zonal
from cellweave.sources import tables

BOX = "aoi string, pos int, minx double, miny double, maxx double, maxy double"


def values(spark, vs, name="v"):
    return spark.createDataFrame([(v,) for v in vs], f"{name} double")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_histogram_edges(spark):
    df = values(spark, [0.0, 1.99, 2.0, 99.9, 100.0, 101.0, None])
    half = dict(rows(zonal.histogram(df, "v", 0.0, 100.0, 50), "bin", "count"))
    closed = dict(rows(zonal.histogram(df, "v", 0.0, 100.0, 50, True), "bin", "count"))
    assert len(half) == 50 and (half[0], half[1], half[49], sum(half.values())) == (2, 1, 1, 4)
    assert closed[49] == 2 and sum(closed.values()) == 5


def test_histogram_auto(spark):
    assert rows(zonal.histogram_auto(values(spark, [3.0, 3.0, None]), "v", 4).orderBy("bin"), "count") == [(2,), (0,), (0,), (0,)]
    assert sum(n for _, n in rows(zonal.histogram_auto(values(spark, [0.0, 1.0, 2.0, 4.0]), "v", 4), "bin", "count")) == 4


def test_shares_and_nonzero(spark):
    cells = spark.createDataFrame([(i, 0, v) for i, v in enumerate([1.0, 0.0, None, 10.0])], "col int, row int, v double")
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 9.0, 9.0), ("none", 1, 50.0, 50.0, 60.0, 60.0)], BOX)
    share = {r.aoi: r for r in zonal.shares(cells, "v", aois).collect()}
    assert share["a"].pct_gt0 == pytest.approx(2 / 3, abs=1e-6) and share["none"].pct_gt0 is None
    some = {r.aoi: r for r in zonal.nonzero(cells, "v", aois).collect()}
    assert (some["a"].mean_nonzero, some["a"].count_nonzero, some["none"].count_nonzero) == (5.5, 2, 0)
    stats = {r.aoi: r for r in zonal.zonal_stats(cells, "v", aois).collect()}
    assert stats["none"]["count"] == 0 and stats["a"].p05 <= stats["a"].p25 <= stats["a"].median <= stats["a"].p75 <= stats["a"].p95


def test_zonal_join_by_blocks_is_the_same(spark):
    cells = spark.range(0, 400).select((F.col("id") % 20).cast("int").alias("col"), F.floor(F.col("id") / 20).cast("int").alias("row"))
    aois = spark.createDataFrame([(f"a{i}", i, i * 1.0, 0.0, i + 3.5, 7.0) for i in range(12)], BOX)
    key = ["aoi", "col", "row"]
    few = sorted(rows(grid.zonal_join(cells, aois), *key))
    assert few == sorted(rows(grid.zonal_join(cells, aois, few=3), *key)) and len(few) > 100


def test_strata(spark):
    got = rows(values(spark, [0.0, 0.1, 4.9, 5.0, None]).select(strata_of(F.col("v")).alias("s")), "s")
    assert got == [(0,), (1,), (1,), (2,), (None,)]


def test_trend_and_change(spark):
    df = spark.createDataFrame([(0, 0, 2018, 1.0), (0, 0, 2019, 3.0), (0, 0, 2020, 5.0), (1, 0, 2020, 7.0)], "col int, row int, year int, v double")
    got = dict(((r.col), (r.trend, r.change)) for r in df.groupBy("col", "row").agg(temporal.trend(F.col("v")), temporal.change(F.col("v"), 2018, 2020)).collect())
    assert got == {0: (2.0, 4.0), 1: (None, None)}


def test_mosaic_takes_the_last_valid(spark):
    df = spark.createDataFrame([(0, 0, 4.0), (1, 0, None), (2, 0, 9.0), (0, 1, 4.0), (1, 1, None)], "tile_id int, col int, v double").withColumn("row", F.lit(0)).withColumn("year", F.lit(1))
    assert sorted(rows(temporal.mosaic(df, ["v"], ["tile_id"]), "col", "v")) == [(0, 9.0), (1, 4.0)]


def test_distance_matches_brute_force(spark):
    hits = {(0, 0), (7, 3), (11, 9)}
    df = spark.createDataFrame([(c, r, 1 if (c, r) in hits else 0) for c in range(14) for r in range(11) if (c + r) % 5], "col int, row int, m int").union(spark.createDataFrame([(*h, 1) for h in hits if sum(h) % 5 == 0], "col int, row int, m int"))
    for radius in (3, 255):
        for r in temporal.distance(temporal.dense(df), F.col("m") == 1, radius, 1.0).collect():
            best = min(math.hypot(r.col - c, r.row - w) for c, w in hits)
            assert r.distance == (pytest.approx(best, abs=1e-6) if best <= radius else None)


def test_distance_on_a_large_sparse_grid(spark):
    r = random.Random(3)
    hits = [(r.randrange(900), r.randrange(700)) for _ in range(25)]
    df = spark.createDataFrame([(0, 0, 0), (899, 699, 0), *((c, w, 1) for c, w in hits)], "col int, row int, m int").groupBy("col", "row").agg(F.max("m").alias("m"))
    grid = temporal.dense(df)
    assert sum(n > 0 for n in grid.rdd.glom().map(len).collect()) > 1
    got = temporal.distance(grid, F.col("m") == 1, 255, 1.0).toPandas()
    assert len(got) == 900 * 700
    best = np.min([np.hypot(got.col - c, got.row - w) for c, w in hits], axis=0)
    assert np.allclose(got.distance.to_numpy(float), np.where(best <= 255, best, np.nan), atol=1e-6, equal_nan=True)


def test_mosaic_is_a_hash_aggregate(spark):
    df = spark.createDataFrame([(0, 0, 0, 1, 4.0)], "tile_id int, col int, row int, year int, v double")
    plan = temporal.mosaic(df, ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert temporal.mosaic(df, ["v"], ["tile_id", "col"]).first().v == 4.0


def test_cube_sources(spark):
    pixels = spark.createDataFrame([(t, y, 0, 0, float(10 * t + y - 2000)) for t in (1, 2) for y in (2001, 2002)], "tile_id int, year int, col int, row int, v double")
    tiles = spark.createDataFrame([(1, y, 0.0, 0.0, 4.0, 4.0) for y in (2001, 2002)] + [(2, y, 0.0, 0.0, 1.0, 1.0) for y in (2001, 2002)], "tile_id int, year int, minx double, miny double, maxx double, maxy double")
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 3.0, 3.0)], BOX)
    assert rows(temporal.feature_cube(pixels, "v", 2001, 2002), "mean", "change") == [(21.5, 1.0)]
    assert rows(temporal.feature_cube(pixels, "v", 2001, 2002, "best_tile", tiles, aois), "aoi", "mean", "change") == [("a", 11.5, 1.0)]
    with pytest.raises(ValueError):
        temporal.feature_cube(pixels, "v", 2001, 2002, "both")


def test_sketched_quantiles(spark):
    cells = spark.range(2000).select((F.col("id") % 50).cast("int").alias("col"), F.floor(F.col("id") / 50).cast("int").alias("row"), F.col("id").cast("double").alias("v"))
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 50.0, 40.0)], BOX)
    exact, near = zonal.zonal_stats(cells, "v", aois).first(), zonal.zonal_stats(cells, "v", aois, accuracy=1000).first()
    assert exact.median == 999.5 and all(abs(exact[c] - near[c]) <= 4 for c in ("median", "p05", "p25", "p75", "p95"))


def test_weights_at_edges(spark):
    cells = spark.createDataFrame([(0, 0, 2.0), (1, 0, 4.0), (2, 0, None), (3, 0, 9.0)], "col int, row int, v double")
    aois = spark.createDataFrame([("a", 0, 0.5, 0.0, 2.5, 0.5), ("none", 1, 7.0, 7.0, 8.0, 8.0)], BOX)
    assert sorted(rows(zonal.weighted_mean(cells, "v", aois), "aoi", "mean", "weight")) == [("a", round((0.25 * 2 + 0.5 * 4) / 0.75, 6), 0.75), ("none", None, None)]


def test_comparison(spark):
    cells = spark.range(400).select((F.col("id") % 20).cast("int").alias("col"), F.floor(F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20 * 5).cast("double").alias("v"))
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 10.0, 20.0), ("b", 1, 10.0, 0.0, 20.0, 20.0)], BOX)
    made = shift.compare(cells, "v", aois, n=300, psi_bins=5, hist_bins=10)
    assert made.samples.count() == 600 and sorted(rows(made.summary, "aoi", "count")) == [("a", 300), ("b", 300)]
    assert 45 < made.shift.first().wasserstein < 55 and sum(n for (n,) in rows(made.histogram, "count")) == 600


def test_partitioned_cells(spark, tmp_path):
    cells = spark.range(6000).select((F.col("id") % 3 + 2000).cast("int").alias("year"), (F.col("id") % 500).cast("int").alias("col"), F.floor(F.col("id") / 500).cast("int").alias("row"), F.col("id").alias("v"))
    tables.write_cells(cells, f"{tmp_path}/cells")
    one = tables.read_cells(spark, f"{tmp_path}/cells", 2001)
    assert one.count() == 2000 and sorted(map(tuple, one.select("year", "col", "row", "v").collect())) == sorted(map(tuple, cells.where("year = 2001").collect()))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "2001" in plan
    listed = tables.files(spark, f"{tmp_path}/cells/year=2001", "*.parquet")
    assert listed.count() >= 1 and listed.where("bytes > 0").count() == listed.count()
    assert sum(n for (n,) in rows(tables.inventory(one, None), "n_cells")) == 2000
    dated = tables.pix_of(spark, "/root/testdata/sf0.001", 2001, 2001)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in dated


def test_mercator_range(spark):
    box = spark.createDataFrame([(0.0, -89.0, 1.0, 10.0)], "minx double, miny double, maxx double, maxy double")
    got = grid.to_web_mercator(box).first()
    assert got.miny is None and got.maxy > 0 and got.minx == 0


def test_wasserstein_and_psi(spark):
    aois = spark.createDataFrame([("c", 0, 0.0, 0.0, 1.0, 1.0), ("a", 1, 0.0, 0.0, 1.0, 1.0), ("b", 2, 0.0, 0.0, 1.0, 1.0)], BOX)

    def of(c, a):
        df = spark.createDataFrame([("c", v) for v in c] + [("a", v) for v in a], "aoi string, v double")
        t = {(r.aoi_a, r.aoi_b): r for r in shift.shift_table(df, "v", aois).collect()}
        assert set(t) == {("c", "a"), ("c", "b"), ("a", "b")} and t["a", "b"].psi is None
        return t["c", "a"].wasserstein, t["c", "a"].psi

    assert of([0.0, 1.0], [1.0, 2.0])[0] == 1.0
    assert of([0.0], [0.0, 2.0])[0] == 1.0
    assert of([5.0, 5.0], [5.0]) == (0.0, 0.0)
    assert of([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]) == (0.0, 0.0)
    assert of([], [1.0]) == (None, None)
    assert of([1.0, math.nan, math.inf], [1.0]) == (0.0, 0.0)


def test_quality(spark):
    assert rows(values(spark, [math.nan, math.inf, 1.0, None]).where(finite(F.col("v"))), "v") == [(1.0,)]
    cells = spark.createDataFrame([("f", v) for v in (-9999.0, 0.0, 0.5, 1.2)] + [("g", -32768.0)], "file string, v double")
    got = qc.nodata_stats(cells, ["file"]).collect()
    assert [tuple(r) for r in got] == [("f", 0.0, 0.5, 1.2, 1)]
    assert rows(qc.usable_files(cells), "file") == [("f",)]
    bands = spark.createDataFrame([(0, 0, 1.0, 2.0, None, 3.0, 4.0, 5.0), (1, 0, *[None] * 6)], "col int, row int, afg double, pfg double, shr double, tre double, ltr double, bg double")
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0), ("b", 1, 1.0, 0.0, 2.0, 1.0)], BOX)
    assert dict(rows(qc.band_sum(bands, aois), "aoi", "sum_mean")) == {"a": 15.0, "b": None}
    for bare in ("bg", "BG", "bgr", "BGR"):
        assert qc.band_sum(bands.withColumnRenamed("bg", bare), aois).first().bands_used == ["afg", "pfg", "shr", "tre", "ltr", bare]
    assert qc.cover_bands(["AFG", "PFG", "SHR", "TRE", "LTR", "BGR", "BG"])[-1] == "BG"
    for gone in ("bg", "tre"):
        with pytest.raises(ValueError):
            qc.band_sum(bands.drop(gone), aois)
    names = spark.createDataFrame(list(enumerate(["annual_precip", "street", "annual_forb", "PFG", "Shr_2", "TRE", "litter", "bare"])), "pos int, band string")
    assert dict(rows(qc.resolve_bands(names), "canonical", "band"))["AFG"] == "annual_forb"
    assert dict(rows(qc.resolve_bands(names), "canonical", "band"))["TRE"] == "street"
    assert qc.resolve_bands(names.where("band <> 'bare'")).count() == 0


def test_require_tiles(spark):
    tiles = spark.createDataFrame([(1, 2000, 0.0, 0.0, 1.0, 1.0)], "tile_id int, year int, minx double, miny double, maxx double, maxy double")
    aois = spark.createDataFrame([("a", 0, 1.0, 1.0, 2.0, 2.0)], BOX)
    assert grid.require_tiles(tiles, aois, 2000).count() == 1
    with pytest.raises(ValueError):
        grid.require_tiles(tiles, aois, 2001)


def test_bilinear(spark):
    src = spark.createDataFrame([(0, 0, 0.0), (1, 0, 10.0), (0, 1, 20.0), (1, 1, 30.0)], "col int, row int, v double")
    assert rows(grid.resample_bilinear(src, "v", grid.coarse_grid(src, 2), 2.0), "v") == [(15.0,)]
    holed = src.withColumn("v", F.when(F.col("v") < 30, F.col("v")))
    assert rows(grid.resample_bilinear(holed, "v", grid.coarse_grid(src, 2), 2.0), "v") == [(10.0,)]


def test_sample_sizes(spark):
    cells = spark.range(3000).select((F.col("id") % 60).cast("int").alias("col"), F.floor(F.col("id") / 60).cast("int").alias("row"), F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("id") % 9 * 1.0).alias("v"))
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 60.0, 50.0), ("b", 1, 0.0, 0.0, 5.0, 4.0)], BOX)
    got = sampling.stratified_sample(cells, "v", aois, n=70, by_class={0: 30}).groupBy("aoi", "strata").count()
    size = grid.zonal_join(sampling.strata(cells, "v"), aois).groupBy("aoi", "strata").count().withColumnRenamed("count", "m")
    for r in got.join(size, ["aoi", "strata"], "full").collect():
        assert r["count"] == min(30 if r.strata == 0 else 70, r.m)


def test_empty_tables(spark):
    cells = spark.createDataFrame([], "col int, row int, year int, tile_id int, v double")
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 1.0, 1.0)], BOX)
    assert rows(zonal.zonal_stats(cells, "v", aois), "aoi", "count") == [("a", 0)]
    assert temporal.mosaic(cells, ["v"], ["tile_id"]).count() == 0
    assert temporal.dense(cells).count() == 0
    assert sampling.at_points(sampling.random_points(aois, 5), cells, ["v"]).count() == 0
    assert rows(grid.coarsen_to_budget(cells, "v", 10), "v") == []


def test_tile_pairs_by_squares_are_the_same(spark):
    tiles = spark.createDataFrame([(i, 2000, i * 3.0, i % 4 * 5.0, i * 3.0 + 9.5, i % 4 * 5.0 + 6.0) for i in range(20)], "tile_id int, year int, minx double, miny double, maxx double, maxy double")
    aois = spark.createDataFrame([(f"a{i}", i, i * 4.0, 2.0, i * 4.0 + 12.0, 9.0) for i in range(9)] + [("far", 9, 900.0, 0.0, 901.0, 1.0)], BOX)
    few, many = (sorted(rows(grid.tile_pairs(tiles, aois, k).select("a.aoi", "t.tile_id"), "aoi", "tile_id")) for k in (256, 2))
    assert few == many and len(few) == len(set(few)) > 20
    assert sorted(map(tuple, grid.tile_hits(tiles, aois).collect())) == sorted(map(tuple, grid.tile_hits(tiles, aois, 2).collect()))

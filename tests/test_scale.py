"""What keeps tasks bounded: positions over many tasks, exact quantiles in rounds, covers, distance over blocks; and values that aren't finite."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import grid, pyramid, qc, resample, sampling, shift, temporal, zonal
from cellweave.operators.prefix import cumulative
from cellweave.operators.proximity import block_distances, with_distances
from cellweave.operators.quantiles import exact_quantiles
from cellweave.sources import tables

BOX = "aoi string, pos int, minx double, miny double, maxx double, maxy double"


def test_one_group_is_numbered_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), F.expr("cast(pmod(hash(id), 5000) as int)").alias("v"), "id")
    df = df.unionByName(spark.createDataFrame([(None, 1, 1), (None, 0, 2), ("b", 7, 3)], "g string, v int, id long"))
    out = cumulative(df, ["g"], [F.col("v"), F.col("id")], {"total": F.col("v")}, {"next": "v"}, stretches=8)
    got = sorted(((r.g or "", r.v, r.id, r.position, r.total, r.all_total, r.next) for r in out.collect()))
    expected, by = [], {}
    for r in df.collect():
        by.setdefault(r.g or "", []).append((r.v, r.id))
    for g, vs in by.items():
        vs.sort()
        sums = np.cumsum([v for v, _ in vs])
        expected += [(g, v, i, k, int(sums[k]), int(sums[-1]), vs[k + 1][0] if k + 1 < len(vs) else None) for k, (v, i) in enumerate(vs)]
    assert got == sorted(expected)


def test_positions_do_not_need_a_group_in_one_task(spark):
    df = spark.range(8_000).select(F.lit("a").alias("g"), F.col("id").alias("v"))
    out = cumulative(df, ["g"], [F.desc("v")], stretches=8)
    sizes = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 8_000 and out.where("position + v <> 7999").isEmpty()


VALUES = {
    "even": list(range(1000)), "one": [3.5], "two": [1.0, 2.0], "equal": [7.0] * 50, "heavy": [0.0] * 900 + list(range(100)), "wide": [10.0**k for k in range(-300, 300, 7)] + [-(10.0**k) for k in range(-300, 300, 11)],
    "ends": [-1.7976931348623157e308, 1.7976931348623157e308, 0.0, 5e-324], "close": [1.0 + k * 2.0**-52 for k in range(40)],
}


def test_quantiles_in_rounds_are_those_of_sorted_values(spark):
    points = {"p0": 0.0, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    df = spark.createDataFrame([(k, float(v)) for k, vs in VALUES.items() for v in vs] + [("none", None), ("nan", math.nan), (None, 4.0), ("even", math.inf)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", points, ["g"], bins=16).collect()}
    assert set(got) == {*VALUES, None} and got[None].p50 == 4.0
    for k, vs in VALUES.items():
        xs = sorted(map(float, vs))
        for name, p in points.items():
            h = p * (len(xs) - 1)
            a, b = xs[math.floor(h)], xs[math.ceil(h)]
            if math.isfinite(b - a):
                assert got[k][name] == pytest.approx(a + (h - math.floor(h)) * (b - a), rel=1e-9, abs=1e-6)


def test_sketches_and_rounds_agree(spark):
    df = spark.range(4000).select((F.col("id") % 977).cast("double").alias("v"), F.lit("f").alias("file"))
    exact, sketch = qc.describe(df, "v").first(), qc.describe(df, "v", accuracy=10_000).first()
    assert exact.__fields__ == sketch.__fields__ and all(abs(a - b) <= 1 for a, b in zip(exact, sketch))
    assert abs(qc.nodata_stats(df, ["file"]).first().median_v - qc.nodata_stats(df, ["file"], accuracy=10_000).first().median_v) <= 1
    aois = spark.createDataFrame([("f", 0, 0.0, 0.0, 1.0, 1.0), ("g", 1, 0.0, 0.0, 1.0, 1.0)], BOX)
    named = df.withColumnRenamed("file", "aoi")
    a, b = ({r.aoi: r for r in sampling.sample_summary(named, "v", aois, accuracy=k).collect()} for k in (None, 10_000))
    assert a["f"].__fields__ == b["f"].__fields__ and abs(a["f"].p95 - b["f"].p95) <= 1 and a["g"]["count"] == b["g"]["count"] == 0 and a["g"].p05 is None


def test_a_region_of_any_size_has_few_squares(spark):
    aois = spark.createDataFrame([("large", 0, 17.0, -33.0, 100_017.0, 99_967.0), ("long", 1, 0.0, 0.0, 1_000_000.0, 3.0), ("cell", 2, 5.0, 5.0, 6.0, 6.0), ("none", 3, 4.0, 4.0, 4.0, 9.0)], BOX)
    squares = {}
    for r in grid.cover(aois).collect():
        squares.setdefault(r.aoi, []).append((r.level, r.qx, r.qy))
    assert set(squares) == {"large", "long", "cell"} and squares["cell"] == [(0, 5, 5)] and len(squares["large"]) < 1000 and len(squares["long"]) < 1000
    r = random.Random(6)
    held = set(squares["large"])
    assert len(held) == len(squares["large"])
    for _ in range(2000):  # every cell of the region lies in exactly one square
        c, w = r.randrange(17, 100_017), r.randrange(-33, 99_967)
        assert sum((level, c >> level, w >> level) in held for level in {x[0] for x in held}) == 1


def test_cells_meet_squares_of_mixed_levels(spark):
    r = random.Random(8)
    boxes = [(f"a{k}", k, x := r.uniform(-50, 300), y := r.uniform(-50, 300), x + r.choice([0.3, 7, 90, 400]), y + r.choice([0.4, 5, 80, 300])) for k in range(20)]
    aois = spark.createDataFrame(boxes, BOX)
    cells = spark.createDataFrame([(r.randrange(-60, 320), r.randrange(-60, 320)) for _ in range(3000)], "col int, row int")
    for scale in (1.0, 2.0):
        a, b = (sorted((x.aoi, x.col, x.row) for x in grid.zonal_join(cells, aois, scale, few=few).collect()) for few in (3, 256))
        assert a == b and len(a) > 1000


def test_block_distances_are_those_of_all_pairs():
    g = np.random.default_rng(5)
    for radius, n in ((3, 5), (7, 40), (20, 3), (20, 200), (20, 0)):
        block = 16
        cells = np.unique(g.integers(0, block, (90, 2)), axis=0)
        hits = np.unique(g.integers(-radius, block + radius, (n, 2)), axis=0) if n else np.zeros((0, 2), np.int64)
        got = block_distances(cells, hits, radius, block)
        squared = ((cells[:, None] - hits[None]) ** 2).sum(2).min(1) if n else np.full(len(cells), 10**9)
        assert (got == np.where(squared <= radius * radius, squared, -1)).all()


def test_distance_over_a_sparse_extent(spark):
    r = random.Random(7)
    hits = [(r.randrange(100_000), r.randrange(100_000)) for _ in range(10)]
    near = [(c + r.randrange(-300, 300), w + r.randrange(-300, 300)) for c, w in hits for _ in range(5)]
    rows = {p: (0, 0) for p in near} | {p: (1, k % 2) for k, p in enumerate(hits)}
    df = spark.createDataFrame([(*p, *m, "kept") for p, m in rows.items()], "col int, row int, m int, n int, cell string")
    got = with_distances(df, {"far": F.col("m") == 1, "odd": F.when(F.col("n") == 1, True)}, 255, 1.0, block=64).collect()
    assert len(got) == len(rows)
    for x in got:
        for name, some in (("far", hits), ("odd", [p for p in hits if rows[p][1]])):
            best = min(math.hypot(x.col - c, x.row - w) for c, w in some)
            assert x[name] == (pytest.approx(best, abs=1e-6) if best <= 255 else None) and x.cell == "kept"
    assert with_distances(df.limit(0), {"far": F.col("m") == 1}).count() == 0
    assert with_distances(df, {"far": F.lit(False)}).where("far is not null").isEmpty()


def test_prior_cube_scans_its_cells_once(spark):
    years = spark.createDataFrame([(y, c, 0, float(c)) for y in (2000, 2001) for c in range(40)], "year int, col int, row int, v double")
    got = {r.col: r for r in temporal.prior_cube(years, "v", 2000, 2001, (5, 30), 12, 1.0).collect()}
    assert (got[0].dist_ge5, got[5].dist_ge5, got[10].dist_ge30, got[20].dist_ge30, got[39].dist_ge30) == (5.0, 0.0, None, 10.0, 0.0) and got[7].cover == 7.0


def test_stratified_features_by_one_cube(spark):
    """The same rows as a sample of the last year joined with the cube; tiles are read while the cube is made, not after."""
    r = random.Random(9)
    years = [(y, c, w, r.choice([None, math.nan, 0.0, 3.0, r.uniform(0, 40)])) for y in (1995, 1998, 2001) for c in range(30) for w in range(20) if r.random() < 0.9]
    df = spark.createDataFrame(years, "year int, col int, row int, v double")
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 12.0, 20.0), ("b", 1, 8.0, 0.0, 30.0, 20.0), ("none", 2, 500.0, 0.0, 510.0, 9.0)], BOX)
    names = ["mean", "std", "change", "trend", "ge5", "ge10"]
    last = df.where("year = 2001").select("col", "row", "v")
    two = sampling.at_points(sampling.stratified_sample(last, "v", aois, n=40), temporal.change_cube(df, "v", 1995, 2001), names)
    one = sampling.stratified_features(df, "v", aois, 1995, 2001, n=40)
    columns = ["aoi", "strata", "col", "row", "v", *names]
    got = sorted(map(tuple, one.select(columns).collect()))
    assert got == sorted(map(tuple, two.select(columns).collect())) and {x[0] for x in got} == {"a", "b"} and {x[1] for x in got} == {0, 1, 2}
    assert one.inputFiles() and all("/cube-" in f for f in one.inputFiles())
    assert sampling.stratified_features(df.limit(0), "v", aois, 1995, 2001).count() == 0


def test_shift_edges_are_exact_quantiles(spark):
    """Edges from running counts over many tasks are the interpolated quantiles of both samples, with ties and one value alone."""
    r = random.Random(17)
    held = {"a": [r.choice([0.0, 2.5, r.gauss(0, 50)]) for _ in range(3000)], "b": [r.choice([0.0, -7.0, r.gauss(9, 5)]) for _ in range(777)], "c": [4.0]}
    samples = spark.createDataFrame([(k, v) for k, vs in held.items() for v in vs], "aoi string, v double").repartition(7)
    aois = spark.createDataFrame([(k, i, 0.0, 0.0, 1.0, 1.0) for i, k in enumerate("abcd")], BOX)
    got = {(x.aoi_a, x.aoi_b): x for x in shift._edges(shift._running(shift._sided(samples, "v", aois)), 20).collect()}
    assert set(got) == {(p, q) for p in "abcd" for q in "abcd" if p < q}
    for (p, q), x in got.items():
        both = held.get(p, []) + held.get(q, [])
        assert (x.ta, x.tb) == (len(held.get(p, [])), len(held.get(q, [])))
        want = sorted({round(float(e), 9) for e in np.quantile(both, np.linspace(0, 1, 21))})
        assert x.edges == pytest.approx(want, abs=2e-9)
    table = {(x.aoi_a, x.aoi_b): x for x in shift.shift_table(samples, "v", aois).collect()}
    assert table["a", "d"].psi is None and table["a", "d"].wasserstein is None and table["a", "b"].psi > 0
    # one value against many: mean distance to it
    assert table["a", "c"].wasserstein == pytest.approx(np.abs(np.array(held["a"]) - 4.0).mean(), abs=1e-6)


ODD = [1.0, 10.0, None, math.nan, math.inf, -math.inf]
FINE = [1.0, 10.0, None]


def test_values_that_are_not_finite_leave_every_statistic(spark):
    """Each statistic over the odd values is that over the finite ones."""
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 99.0, 9.0), ("b", 1, 0.0, 0.0, 99.0, 9.0), ("none", 2, 500.0, 0.0, 510.0, 9.0)], BOX)
    best = spark.createDataFrame([("a", 7)], "aoi string, tile_id int")

    def made(vs):
        cells = spark.createDataFrame([(k, 0, 2001, v) for k, v in enumerate(vs)], "col int, row int, year int, v double")
        six = cells.select("col", "row", *[F.col("v").alias(b) for b in ("afg", "pfg", "shr", "tre", "ltr", "bgr")])
        one = cells.withColumn("col", F.lit(1))
        files = cells.withColumn("file", F.lit("f"))
        named = spark.createDataFrame([("a",), ("b",)], "aoi string").crossJoin(cells)
        return {
            "stats": zonal.zonal_stats(cells, "v", aois), "sketch": zonal.zonal_stats(cells, "v", aois, 1000), "weighted": zonal.weighted_mean(cells, "v", aois), "shares": zonal.shares(cells, "v", aois), "nonzero": zonal.nonzero(cells, "v", aois),
            "report": zonal.region_report(cells, "v", aois, best), "cube": zonal.cube_summary(cells, ["v"], aois), "half": zonal.histogram(cells, "v", 0.0, 20.0, 5), "closed": zonal.histogram(named, "v", 0.0, 10.0, 5, True, ("aoi",), aois),
            "auto": zonal.histogram_auto(cells, "v", 4), "range": qc.range_coverage(cells, "v", aois, 0.0, 5.0), "distribution": qc.distribution(cells, "v", aois), "sum": qc.band_sum(six, aois), "usable": qc.usable_files(files), "nodata": qc.nodata_stats(files, ["file"]),
            "describe": qc.describe(cells, "v"), "summary": sampling.sample_summary(named, "v", aois), "change": temporal.change_cube(one, "v", 2001, 2001, keys=["row"]), "trend": one.groupBy("row").agg(temporal.trend(F.col("v"))),
            "wasserstein": shift.wasserstein(named, "v", aois), "psi": shift.psi(named, "v", aois), "table": shift.shift_table(named, "v", aois),
        }

    odd, fine = made(ODD), made(FINE)
    for name in odd:
        a, b = (sorted((tuple(r) for r in x[name].collect()), key=repr) for x in (odd, fine))
        assert a == b, name
    cells = spark.createDataFrame([(k, v) for k, v in enumerate(ODD)], "k int, v double")
    assert [r.ge5 for r in temporal.thresholds(cells, "v").orderBy("k").collect()] == [False, True, None, None, None, None]
    assert [r.strata for r in sampling.strata(cells, "v").orderBy("k").collect()] == [1, 2, None, None, None, None]


def test_every_declared_region_has_bins(spark):
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 9.0, 9.0), ("none", 1, 50.0, 0.0, 60.0, 9.0)], BOX)
    df = spark.createDataFrame([("a", 1.0)], "aoi string, v double")
    got = zonal.histogram(df, "v", 0.0, 4.0, 4, True, ("aoi",), aois).collect()
    assert sorted((r.aoi, r["count"]) for r in got) == [("a", 0)] * 3 + [("a", 1)] + [("none", 0)] * 4


def test_comparison_over_cells_of_any_size(spark):
    cells = spark.createDataFrame([(c, r, float(c)) for c in range(10) for r in range(10)], "col int, row int, v double")
    aois = spark.createDataFrame([("a", 0, 0.0, 0.0, 50.0, 100.0), ("b", 1, 50.0, 0.0, 100.0, 100.0)], BOX)
    made = shift.compare(cells, "v", aois, n=400, scale=10.0)
    assert made.shift.first().wasserstein == pytest.approx(5.0, abs=0.3) and made.samples.where("aoi = 'a' and v >= 5").isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(spark, df):
    """Files that the executed scan of a collection read."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        metrics = node.metrics()
        if metrics.contains("numFiles"):
            found += metrics.apply("numFiles").value()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            left.append(node.plan())
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
    return found


def test_regions_prune_a_collections_folders(spark, tmp_path):
    cells = spark.range(64 * 64).select((F.col("id") % 64 - 16).cast("int").alias("col"), F.floor(F.col("id") / 64).cast("int").alias("row"), F.lit(2001).alias("year"), F.col("id").cast("double").alias("v"))
    tables.write_cells(cells, f"file://{tmp_path}/cells", area=8)
    held = tables.read_cells(spark, f"file://{tmp_path}/cells", 2001)
    made = {}
    for name, box in {"small": (1.0, 1.0, 6.0, 6.0), "half": (-16.0, 0.0, 48.0, 31.0), "all": (-16.0, 0.0, 47.0, 63.0)}.items():
        aois = spark.createDataFrame([(name, 0, *box)], BOX)
        near = tables.cells_near(held, aois, 8)
        assert "dynamicpruning" in plan(near)
        made[name] = files_read(spark, near)
        x0, y0, x1, y1 = (math.floor(v / 8) for v in box)
        assert near.count() == (min(x1, 5) - x0 + 1) * (y1 - y0 + 1) * 64
    assert made["small"] == 1 and made["small"] < made["half"] < made["all"]


def test_morton_numbers_take_bits_in_turn(spark):
    df = spark.createDataFrame([(x, y) for x in range(4) for y in range(4)], "x int, y int")
    got = {(r.x, r.y): r.m for r in df.select("x", "y", tables.morton(F.col("x"), F.col("y")).alias("m")).collect()}
    assert got == {(x, y): (x & 1) | (y & 1) << 1 | (x >> 1) << 2 | (y >> 1) << 3 for x in range(4) for y in range(4)}


def test_footers_answer_without_rows(spark, tmp_path):
    rows = [("all", -32768.0)] * 3 + [("some", -32768.0), ("some", 4.0)] + [("full", float(k)) for k in range(9)] + [("nan", math.nan), ("nan", -32768.0)] + [("none", None)] + [("inf", math.inf)]
    path = f"file://{tmp_path}/rasters"
    spark.createDataFrame(rows, "file string, v double").repartition(3, "file").write.partitionBy("file").parquet(path)
    names = ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")
    before = [spark.conf.get(n) for n in names]
    got = {r.file: (r.n, r.lo, r.hi) for r in tables.footers(spark, path, ["file"]).collect()}
    assert got["all"] == (3, -32768.0, -32768.0) and got["full"] == (9, 0.0, 8.0) and got["none"] == (1, None, None)
    told = spark.read.parquet(path).where("file in ('all', 'some', 'full')")
    told.write.partitionBy("file").parquet(f"{path}-told")
    assert {r.file: r.hi for r in tables.footers(spark, f"{path}-told", ["file"]).collect()} == {"all": -32768.0, "some": 4.0, "full": 8.0}
    assert [spark.conf.get(n) for n in names] == before
    try:
        spark.conf.set(names[0], "csv"), spark.conf.set(names[1], "true")
        assert "PushedAggregation: [COUNT(*), MIN(v), MAX(v)]" in plan(tables.footer_bounds(spark, path, ["file"]))
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
    assert {r.file: r.usable for r in qc.usable_by_footers(spark, path).collect()} == {"all": False, "some": True, "full": True, "nan": False, "none": False, "inf": False}


def test_overviews_are_those_of_the_base(spark):
    r = random.Random(12)
    vs = {(r.randrange(-40, 90), r.randrange(-20, 70)): r.choice([None, math.nan, r.uniform(0, 9)]) for _ in range(900)}
    cells = spark.createDataFrame([(*k, v) for k, v in vs.items()], "col int, row int, v double")
    made = pyramid.Pyramid.build(cells, "v")
    fine = {k: v for k, v in vs.items() if v is not None and math.isfinite(v)}
    for k in range(len(made.levels)):
        blocks = {}
        for (c, w), v in fine.items():
            blocks.setdefault((c >> k, w >> k), []).append(v)
        assert made.counts[k] == len(blocks)
        assert {(x.col, x.row): x.v for x in made.level(k).collect()} == {p: pytest.approx(sum(b) / len(b), abs=1e-5) for p, b in blocks.items()}
    within = made.within(100)
    assert within.count() <= 100 < made.counts[made.counts.index(within.count()) - 1] and within.first().factor == 1 << made.counts.index(within.count())
    assert "level-" in "".join(within.inputFiles()) and pyramid.Pyramid.build(cells.limit(0), "v").within(5).count() == 0


def test_bands_are_resampled_together(spark):
    r = random.Random(13)
    made = {(c, w): (r.choice([None, math.nan, r.uniform(0, 50)]), r.uniform(-5, 5), r.choice(["a", "b", None])) for c in range(-20, 40) for w in range(-9, 30) if r.random() < 0.8}
    cells = spark.createDataFrame([(*k, *v) for k, v in made.items()], "col int, row int, v double, u double, kind string")
    for ratio in (2.0, 0.4):
        target = spark.createDataFrame([(c, w) for c in range(-12, 25) for w in range(-6, 20)], "col int, row int")
        got = {(x.col, x.row): x for x in resample.resample(cells, ["v", "u"], ["kind"], target, ratio, block=8).collect()}
        assert len(got) == 37 * 26
        a, b = ({(x.col, x.row): x[n] for x in grid.resample_bilinear(cells.where(F.col(n).isNotNull() & ~F.isnan(n)), n, target, ratio).collect()} for n in ("v", "u"))
        for (c, w), x in got.items():
            assert (x.v, x.u) == (a[c, w] if a[c, w] is None else pytest.approx(a[c, w], abs=2e-6), b[c, w] if b[c, w] is None else pytest.approx(b[c, w], abs=2e-6))
            assert x.kind == made.get((math.floor((c + 0.5) * ratio), math.floor((w + 0.5) * ratio)), (0, 0, None))[2]
    both = resample.cat(cells.select("col", "row", "v"), cells.select("col", "row", "kind", "v").limit(5))
    assert both.columns == ["col", "row", "v", "kind"] and both.count() == len(made) and both.where("kind is not null").count() <= 5

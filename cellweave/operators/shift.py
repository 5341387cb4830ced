"""How far two regions' distributions are apart: Wasserstein-1 distance and population stability index.

Samples are grouped to distinct values by region first, so what the pairwise steps move does not grow with
repeats. Pairs are those of regions in their declared order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.functions.columns import finite, rounded
from cellweave.operators import sampling, zonal
from cellweave.operators.grid import sent_if_few
from cellweave.operators.prefix import cumulative
from cellweave.sources.tables import written

#: the columns that name a pair of regions
PAIR = ["aoi_a", "aoi_b"]


def _pairs(aois: DataFrame) -> DataFrame:
    a, b = aois.select(F.col("aoi").alias("aoi_a"), F.col("pos").alias("pa")), aois.select(F.col("aoi").alias("aoi_b"), F.col("pos").alias("pb"))
    return a.join(sent_if_few(b, aois), F.col("pa") < F.col("pb")).select(*PAIR)


def _sided(samples: DataFrame, v: str, aois: DataFrame) -> DataFrame:
    """``(aoi_a, aoi_b, v, na, nb)``: how often each value stands in either sample of each pair."""
    counts = samples.where(finite(F.col(v))).groupBy("aoi", F.col(v).alias("v")).agg(F.count("*").alias("k"))
    side = lambda c, is_a: F.struct(F.col(c).alias("aoi"), F.lit(is_a).alias("is_a"))
    sides = _pairs(aois).select(*PAIR, F.explode(F.array(side("aoi_a", True), side("aoi_b", False))).alias("s")).select(*PAIR, "s.aoi", "s.is_a")
    held = counts.join(sent_if_few(sides, aois), "aoi")
    n = lambda cond: F.sum(F.when(cond, F.col("k")).otherwise(0))
    return held.groupBy(*PAIR, "v").agg(n(F.col("is_a")).alias("na"), n(~F.col("is_a")).alias("nb"))


def _running(sided: DataFrame) -> DataFrame:
    """The same with how many of either sample are at or below each value, and the next value: a pair's values are dealt to many tasks."""
    return cumulative(sided, PAIR, [F.col("v")], {"below_a": F.col("na"), "below_b": F.col("nb")}, {"next": "v"})


def wasserstein(samples: DataFrame, v: str, aois: DataFrame) -> DataFrame:
    """``(aoi_a, aoi_b, wasserstein)``: the area between the two distribution functions; null if a sample is empty.

    Both functions are running sums over a pair's values, which are dealt to many tasks.
    """
    return _pairs(aois).join(_area_between(_running(_sided(samples, v, aois))), PAIR, "left")


def _area_between(running: DataFrame) -> DataFrame:
    part = lambda s: F.col(f"below_{s}") / F.nullif(F.col(f"all_below_{s}"), F.lit(0))
    area = F.sum(F.abs(part("a") - part("b")) * (F.coalesce("next", "v") - F.col("v")))
    return running.groupBy(*PAIR).agg(rounded(area).alias("wasserstein"))


def psi(samples: DataFrame, v: str, aois: DataFrame, bins: int = 20, eps: float = 1e-6) -> DataFrame:
    """``(aoi_a, aoi_b, psi)`` over bins at quantiles of both samples together.

    Edges are rounded to 9 digits and made distinct; fewer than three give 0. Shares are cut off at eps from
    below and not renormalised. Null if a sample is empty. No task holds a pair's values: edges are read off
    their running counts.
    """
    return _stability(written(_running(_sided(samples, v, aois)), "running"), aois, bins, eps)


def _edges(running: DataFrame, bins: int) -> DataFrame:
    """``(aoi_a, aoi_b, edges, ta, tb)``: interpolated quantiles of both samples together, and the samples' sizes.

    The value of rank r is the one whose running count passes r first; two ranks to an edge leave a pair.
    """
    total, upto = F.col("all_below_a") + F.col("all_below_b"), F.col("below_a") + F.col("below_b")
    at = lambda n: [F.lit(k / bins) * (n - 1) for k in range(bins + 1)]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in at(total)])))
    here = F.filter(ranks, lambda r: (r >= upto - F.col("na") - F.col("nb")) & (r < upto))
    found = running.select(*PAIR, "v", F.col("all_below_a").alias("ta"), F.col("all_below_b").alias("tb"), F.explode(here).alias("r"))
    held = found.groupBy(*PAIR, "ta", "tb").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("x"))
    x, edges = F.col("x"), []
    for h in at(F.col("ta") + F.col("tb")):
        lower, upper = F.floor(h), F.ceil(h)
        edges.append(F.round(F.when(lower == upper, x[lower]).otherwise((upper - h) * x[lower] + (h - lower) * x[upper]), 9))
    return held.select(*PAIR, F.array_sort(F.array_distinct(F.array(*edges))).alias("edges"), "ta", "tb")


def _stability(running: DataFrame, aois: DataFrame, bins: int = 20, eps: float = 1e-6) -> DataFrame:
    edges = written(_edges(running, bins), "edges")
    laid = running.select(*PAIR, "v", "na", "nb").join(sent_if_few(edges.select(*PAIR, "edges"), aois), PAIR)
    bin_of = F.least(F.size(F.filter("edges", lambda e: e <= F.col("v"))), F.size("edges") - 1) - 1
    inside = (F.col("v") >= F.col("edges")[0]) & (F.col("v") <= F.element_at("edges", -1))
    counts = laid.where(inside).groupBy(*PAIR, bin_of.alias("bin")).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    dense = edges.where(F.size("edges") >= 3).select(*PAIR, F.explode(F.sequence(F.lit(0), F.size("edges") - 2)).alias("bin"))
    full = dense.join(counts, [*PAIR, "bin"], "left").na.fill(0, ["na", "nb"])
    pair = W.partitionBy(*PAIR)
    part = lambda c: F.greatest(F.col(c) / F.greatest(F.sum(c).over(pair), F.lit(1)), F.lit(eps))
    terms = full.select(*PAIR, part("na").alias("pa"), part("nb").alias("pb"))
    made = terms.groupBy(*PAIR).agg(F.sum((F.col("pa") - F.col("pb")) * F.log(F.col("pa") / F.col("pb"))).alias("raw"))
    value = F.when((F.col("ta") > 0) & (F.col("tb") > 0), F.coalesce("raw", F.lit(0.0)))
    return _pairs(aois).join(edges.drop("edges").join(made, PAIR, "left").select(*PAIR, rounded(value).alias("psi")), PAIR, "left")


def shift_table(samples: DataFrame, v: str, aois: DataFrame, bins: int = 20) -> DataFrame:
    """Both metrics of each pair, from one table of the running counts of the pair's values."""
    running = written(_running(_sided(samples, v, aois)), "running")
    return _pairs(aois).join(_area_between(running), PAIR, "left").join(_stability(running, aois, bins), PAIR)


class Comparison(NamedTuple):
    summary: DataFrame
    shift: DataFrame
    histogram: DataFrame
    samples: DataFrame


def compare(cells: DataFrame, v: str, aois: DataFrame, n: int = 5000, seed: int = 42, psi_bins: int = 20, hist_bins: int = 50, hist_range: tuple[float, float] = (0.0, 100.0), scale: float = 1.0) -> Comparison:
    """One band's distribution across regions, from n random points in each: summary, shift table, histogram
    (of every region) and the samples. ``scale`` is the cells' size in the regions' units."""
    samples = sampling.at_points(sampling.random_points(aois, n, seed, scale), cells, [v]).where(finite(F.col(v)))
    return Comparison(
        sampling.sample_summary(samples, v, aois), shift_table(samples, v, aois, psi_bins),
        zonal.histogram(samples, v, *hist_range, hist_bins, closed=True, keys=("aoi",), groups=aois), samples)

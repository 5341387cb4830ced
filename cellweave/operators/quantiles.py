"""Exact quantiles with state of bounded size: order statistics by rounds of narrowing bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.functions.columns import finite, rounded
from cellweave.sources.tables import written

BINS = 4096


def _bin(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """The bin of v in [lo, hi], rising with v; lo and hi are in different ones.

    An interval around zero is cut at zero, one of several magnitudes by logarithms, any other into equal parts.
    """
    size = lambda c: F.log(F.abs(c))
    # halves, so that no difference overflows; two least numbers have none
    equal = F.coalesce(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), (v > lo).cast("double"))
    share = F.when(F.abs(size(hi) - size(lo)) > 1, (size(v) - size(lo)) / (size(hi) - size(lo))).otherwise(equal)
    by_sign = F.when(v < 0, 0).when(v == 0, 1).otherwise(2)
    return F.when((lo <= 0) & (hi >= 0), by_sign.cast("long")).otherwise(F.least(F.floor(share * bins), F.lit(bins - 1)))


def exact_quantiles(df: DataFrame, v: str, points: dict[str, float], keys: list[str], bins: int = BINS) -> DataFrame:
    """``(keys, names)``: interpolated quantiles of the finite values of each group; groups without any have no row.

    Each round counts the values of the intervals that hold a wanted rank by ``bins`` bins, in one aggregation for
    all groups and ranks; the bin of a rank, from its least to its greatest value, is the next interval. An interval
    of one value is done. No step holds more than the bins of the wanted ranks, however many distinct values a group
    has: floating-point bins keep the order of values, so ranks are exact, and a round parts the least value from
    the greatest one, so rounds end. Values of all magnitudes take some seven rounds, most columns two or three.
    """
    held = written(df.where(finite(F.col(v))).select(*keys, F.col(v).cast("double").alias("v")), "values")
    base = held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = {k: F.lit(float(p)) * (F.col("n") - 1) for k, p in points.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in at.values()])))
    state = written(base.select(*keys, "lo", "hi", F.lit(0).cast("long").alias("below"), F.explode(ranks).alias("r")), "ranks")
    named = [F.col(k).alias(f"of_{k}") for k in keys]
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    while not state.where("lo < hi").isEmpty():
        found = state.where("lo < hi").groupBy(*keys, "lo", "hi", "below").agg(F.collect_set("r").alias("rs"))
        inside = held.join(found.select(*named, "lo", "hi", "below", "rs"), match & F.col("v").between(F.col("lo"), F.col("hi")))
        of = _bin(F.col("v"), F.col("lo"), F.col("hi"), bins)
        interval = [*[f"of_{k}" for k in keys], "lo", "hi", "below", "rs"]
        counts = inside.groupBy(*interval, of.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.col("below") + F.sum("c").over(W.partitionBy(*interval).orderBy("bin"))
        picked = counts.withColumn("upto", upto).withColumn("r", F.explode("rs")).where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("c")))
        narrowed = picked.select(*[F.col(f"of_{k}").alias(k) for k in keys], F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("c")).alias("below"), "r")
        state = written(state.where("lo = hi").unionByName(narrowed), "ranks")
    values = state.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "lo"))).alias("x"))
    both = base.select(*keys, "n").join(values.select(*named, "x"), match)
    lower, upper = {k: F.col("x")[F.floor(h)] for k, h in at.items()}, {k: F.col("x")[F.ceil(h)] for k, h in at.items()}
    return both.select(*keys, *[rounded(lower[k] + (h - F.floor(h)) * (upper[k] - lower[k])).alias(k) for k, h in at.items()])


def with_quantiles(df: DataFrame, made: DataFrame, v: str, points: dict[str, float], keys: list[str]) -> DataFrame:
    """``made``, a row for each group, with exact quantiles of v; null for groups without finite values."""
    found = exact_quantiles(df, v, points, keys)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return made.join(found.select(*[F.col(k).alias(f"of_{k}") for k in keys], *points), on, "left").select(*made.columns, *points)

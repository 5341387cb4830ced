"""Column expressions shared by the operators. All are built-in functions: no Python runs on executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: kilometres in a degree of latitude
KM_PER_DEGREE = 111.32
EARTH_RADIUS = 6378137.0
#: degrees of latitude that Web Mercator reaches to
MERCATOR_LIMIT = 85.06
DIGITS = 6


def rounded(c: Column) -> Column:
    return F.round(c, DIGITS)


def finite(v: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))


def sound(v: Column) -> Column:
    """The value where it is finite, else null: what every statistic looks at."""
    return F.when(finite(v), v)


def share(cond: Column) -> Column:
    """Aggregate: the fraction (0 to 1) of valid cells for which cond holds; nulls leave the denominator."""
    return F.avg(cond.cast("double"))


QUANTILES = {"median": 0.5, "p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95}


def statistics(v: Column, names: tuple[str, ...], prefix: str = "", accuracy: int | None = None) -> list[Column]:
    """Aggregates of one band's finite values by name, for one ``agg`` over one scan.

    All quantiles come from one aggregate: exact and interpolated, which holds each group's distinct values, or
    with an ``accuracy`` a sketch of bounded size whose ranks are off by at most one part in so many.
    """
    v = sound(v)
    wanted = [n for n in names if n in QUANTILES]
    points = F.array(*[F.lit(QUANTILES[n]) for n in wanted])
    quantiles = F.percentile(v, points) if accuracy is None else F.percentile_approx(v, points, accuracy)
    made = {"count": F.count(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "std": F.stddev_pop(v), "pct_gt0": share(v > 0)}
    made |= {n: quantiles[k] for k, n in enumerate(wanted)}
    return [(made[n] if n == "count" else rounded(made[n])).alias(f"{prefix}{n}") for n in names]


def degrees_east(km: Column | float, lat: Column) -> Column:
    """Degrees of longitude that so many kilometres span at a latitude."""
    return (F.lit(km) if not isinstance(km, Column) else km) / (F.lit(KM_PER_DEGREE) * F.cos(F.radians(lat)))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres of longitude and latitude; y is null beyond the projection's range."""
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS
    return F.radians(lon) * EARTH_RADIUS, F.when(F.abs(lat) <= MERCATOR_LIMIT, y)


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of a text's MD5: equal in every engine and partitioning."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def strata_of(v: Column, threshold: float = 5.0) -> Column:
    """0 for none, 1 for some below the threshold, 2 from it on; null where the value isn't finite."""
    v = sound(v)
    return (v > 0).cast("int") + (v >= threshold).cast("int")

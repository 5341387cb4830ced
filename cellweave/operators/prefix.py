"""Positions and running sums of groups of any size: a group's rows are dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.sources.tables import written

#: the stretch of the whole order that a row lies in
STRETCH = "stretch_of_order"


def same(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    """Equality of key columns, nulls too."""
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def cumulative(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, following: dict[str, str] | None = None, stretches: int | None = None) -> DataFrame:
    """Rows with ``position`` in their group (from 0), and for each of ``sums`` the sum up to and with the row, and ``all_<name>`` over the group.

    The table is range-partitioned by group and order and written with each range's number; a window counts within
    a range only, and the ranges' totals, a row for each group and range, give what goes before. So a group's rows
    are never in one task, whatever its size. Rows of equal order stay in one range, as far as order tells rows
    apart. ``following`` names columns that get the next row's value of a column by which rows rise.
    """
    sums, following = sums or {}, following or {}
    spread = df.repartitionByRange(stretches, *keys, *order) if stretches else df.repartitionByRange(*[F.col(k) for k in keys], *order)
    laid = written(spread.withColumn(STRETCH, F.spark_partition_id()), "stretches")
    totals = laid.groupBy(*keys, STRETCH).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"sum_{k}") for k, c in sums.items()], *[F.min(v).alias(f"first_{k}") for k, v in following.items()])
    group = W.partitionBy(*keys)
    before = group.orderBy(STRETCH).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"of_{k}") for k in keys], F.col(STRETCH).alias("of_stretch"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        *[F.coalesce(F.sum(f"sum_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in sums], *[F.sum(f"sum_{k}").over(group).alias(f"all_{k}") for k in sums],
        *[F.lead(f"first_{k}").over(group.orderBy(STRETCH)).alias(f"next_{k}") for k in following])
    on = F.col(STRETCH) == F.col("of_stretch")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    within = W.partitionBy(*keys, STRETCH).orderBy(*order)
    out = laid.join(offsets, on).withColumn("position", F.col("offset") + F.row_number().over(within) - 1)
    rows = within.rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumns({k: F.col(f"before_{k}") + F.coalesce(F.sum(c).over(rows), F.lit(0)) for k, c in sums.items()} | {k: F.coalesce(F.lead(v).over(within), F.col(f"next_{k}")) for k, v in following.items()})
    return out.select(*df.columns, "position", *sums, *[f"all_{k}" for k in sums], *following)

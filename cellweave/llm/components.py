"""Connected components of a link table by alternating large-star and small-star steps.

Labels travel through Spark joins and aggregations; nothing of them reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._shared import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or the smaller) neighbours of each node at its smallest neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(low, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select("v", "m").union(low.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str, rounds: int = 40) -> DataFrame:
    """``(node, root)`` for each node of ``links(a, b)``; the root is the smallest node it reaches.

    Each round is written to the shared folder. Nulls and self-links are ignored; no links, no rows.
    """
    now = scratch.write(f"{name}-0", links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for k in range(1, rounds + 1):
        now = scratch.write(f"{name}-{k}", _star(_star(now, True), False))
        scratch.drop(f"{name}-{k - 1}")
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components of {name} are not settled after {rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Continuous bands interpolated and categorical ones looked up together, on another grid, block by block.

Source cells are packed by blocks with a border copied from their neighbours, in one shuffle; a block's target
cells then find all four neighbours of theirs in their own block, and no target cell is sent about for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.columns import rounded
from cellweave.sources.tables import ship

BLOCK = 128


def cat(first: DataFrame, second: DataFrame) -> DataFrame:
    """The bands of two tables of cells side by side: cells of the first, null where the second has none; a band of both is the first one's."""
    more = [c for c in second.columns if c not in first.columns]
    return first.join(second.select("col", "row", *more), ["col", "row"], "left")


def interpolate(x: np.ndarray, y: np.ndarray, col: np.ndarray, row: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """v at places (x, y) in units of cells from a block's corner, from the four cells around; over those that are valid, else NaN."""
    grid = np.full((size + 2, size + 2), np.nan)
    grid[row + 1, col + 1] = v
    c, r = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    total, weight = np.zeros(len(x)), np.zeros(len(x))
    for i in (0, 1):
        for j in (0, 1):
            w = (x - c if i else 1 - (x - c)) * (y - r if j else 1 - (y - r))
            there = grid[r + j + 1, c + i + 1]
            some = ~np.isnan(there)
            total += np.where(some, w * np.nan_to_num(there), 0)
            weight += np.where(some, w, 0)
    return np.divide(total, weight, out=np.full(len(x), np.nan), where=weight > 0)


def resample(cells: DataFrame, continuous: list[str], categorical: list[str], target: DataFrame, ratio: float, block: int = BLOCK) -> DataFrame:
    """``target`` cells (one row for each col and row) with all bands of ``cells``, one row for each of theirs.

    A target cell is ``ratio`` source cells wide. Continuous bands are interpolated from the four source cells around
    its centre, over those whose value is finite; categorical ones are those of the source cell that holds it.
    """
    ship(cells.sparkSession)
    bands = [*continuous, *categorical]
    # a source cell stands in its own block and, on an edge, in the border of the next ones
    around = lambda c: F.array_distinct(F.array(F.floor((F.col(c) - 1) / block), F.floor(F.col(c) / block), F.floor((F.col(c) + 1) / block)))
    source = cells.select("col", "row", *[F.col(b).cast("double").alias(b) for b in continuous], *categorical)
    sent = source.withColumn("bx", F.explode(around("col"))).withColumn("by", F.explode(around("row")))
    local = lambda c, b: (F.col(c) - F.col(b) * block).cast("int").alias(c)
    packed = sent.groupBy("bx", "by").agg(F.collect_list(F.struct(local("col", "bx"), local("row", "by"), *bands)).alias("source"))
    x, y = (F.col("col") + 0.5) * ratio, (F.col("row") + 0.5) * ratio
    asked = target.select("col", "row", x.alias("x"), y.alias("y")).withColumns({"tx": F.floor(F.col("x") / block), "ty": F.floor(F.col("y") / block)})
    asked = asked.groupBy("tx", "ty").agg(F.collect_list(F.struct("col", "row", (F.col("x") - F.col("tx") * block).alias("x"), (F.col("y") - F.col("ty") * block).alias("y"))).alias("asked"))
    met = asked.join(packed, (F.col("bx") == F.col("tx")) & (F.col("by") == F.col("ty")), "left").select("asked", "source")
    kinds = {b: "double" for b in continuous} | {b: cells.schema[b].dataType.simpleString() for b in categorical}

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                want, held = batch.column("asked")[k].values, batch.column("source")[k]
                x, y = want.field("x").to_numpy(), want.field("y").to_numpy()
                out = [want.field("col"), want.field("row")]
                if not held.is_valid:
                    out += [pa.nulls(len(want), batch.column("source").type.value_type.field(b).type) for b in bands]
                else:
                    cell = held.values
                    col, row = cell.field("col").to_numpy().astype(np.int64), cell.field("row").to_numpy().astype(np.int64)
                    for b in continuous:
                        v = cell.field(b).to_numpy(zero_copy_only=False).astype(float)
                        v[~np.isfinite(v)] = np.nan
                        got = interpolate(x - 0.5, y - 0.5, col, row, v, block)
                        out.append(pa.array(got, pa.float64(), mask=np.isnan(got)))
                    place = np.full((block + 2, block + 2), -1)
                    place[row + 1, col + 1] = np.arange(len(cell))
                    at = place[np.floor(y).astype(np.int64) + 1, np.floor(x).astype(np.int64) + 1]
                    at = pa.array(at, pa.int64(), mask=at < 0)
                    out += [cell.field(b).take(at) for b in categorical]
                yield pa.RecordBatch.from_arrays(out, names=["col", "row", *bands])

    made = met.mapInArrow(run, f"col {target.schema['col'].dataType.simpleString()}, row {target.schema['row'].dataType.simpleString()}, " + ", ".join(f"`{b}` {t}" for b, t in kinds.items()))
    return made.select("col", "row", *[rounded(F.col(b)).alias(b) for b in continuous], *categorical)

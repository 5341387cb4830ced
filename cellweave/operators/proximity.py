"""Distance to the nearest hit, exact, by lower envelopes over blocks of cells.

Cells are packed by blocks; blocks send their hits to the blocks in reach, and each block with its halo makes a
separable distance transform: the gap to the nearest hit in a cell's own column, then the lower envelope of the
parabolas that stand on a row's gaps. Only blocks that hold cells are worked on, so an extent may be as sparse as
it likes; a block of ``BLOCK`` cells and its halo bound a task's memory.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.columns import rounded
from cellweave.sources.tables import ship, written

BLOCK = 256


def envelope(gap: np.ndarray, none: int, columns: np.ndarray) -> np.ndarray:
    """For each row of gaps (``none`` where a column has no hit) the least (x - c)^2 + gap(c)^2 at each of ``columns``, or -1.

    The parabola of each column enters from the right and takes the place of those that it hides, in all rows at once.
    """
    n, width = gap.shape
    height = gap.astype(np.int64) ** 2 + np.arange(width) ** 2
    place, start, top = np.zeros((n, width), np.int64), np.full((n, width + 1), np.inf), np.full(n, -1)
    for c in range(width):
        rows = np.flatnonzero(gap[:, c] != none)
        cross = np.full(len(rows), -np.inf)
        ask = np.flatnonzero(top[rows] >= 0)
        while len(ask):
            r = rows[ask]
            p = place[r, top[r]]
            cross[ask] = (height[r, c] - height[r, p]) / (2.0 * (c - p))
            hidden = cross[ask] <= start[r, top[r]]
            top[r[hidden]] -= 1
            ask = ask[hidden]
            cross[ask] = -np.inf
            ask = ask[top[rows[ask]] >= 0]
        top[rows] += 1
        place[rows, top[rows]], start[rows, top[rows]] = c, cross
        start[rows, top[rows] + 1] = np.inf
    out, at, every = np.full((n, len(columns)), -1, np.int64), np.zeros(n, np.int64), np.arange(n)
    some = top >= 0
    for k, x in enumerate(columns):
        while (on := some & (start[every, np.minimum(at + 1, width)] < x) & (at < top)).any():
            at[on] += 1
        p = place[every, at]
        out[:, k] = np.where(some, (x - p) ** 2 + gap[every, p].astype(np.int64) ** 2, -1)
    return out


def block_distances(cells: np.ndarray, hits: np.ndarray, radius: int, block: int) -> np.ndarray:
    """Squared distances of cells (x, y) in a block to the nearest of ``hits`` in and around it; -1 beyond the radius."""
    if not len(cells) or not len(hits):
        return np.full(len(cells), -1, np.int64)
    rows, columns = np.unique(cells[:, 1]), np.unique(cells[:, 0])
    height, width, none = block + 2 * radius, block + 2 * radius, radius + 1
    hit = np.zeros((height, width), bool)
    hit[hits[:, 1] + radius, hits[:, 0] + radius] = True
    line = np.arange(height)[:, None]
    above = np.maximum.accumulate(np.where(hit, line, -none), 0)[rows + radius]
    below = np.minimum.accumulate(np.where(hit, line, height + none)[::-1], 0)[::-1][rows + radius]
    here = rows[:, None] + radius
    gap = np.minimum(np.minimum(here - above, below - here), none)
    squared = envelope(gap, none, columns + radius)
    out = squared[np.searchsorted(rows, cells[:, 1]), np.searchsorted(columns, cells[:, 0])]
    return np.where(out > radius * radius, -1, out)


def with_distances(cells: DataFrame, masks: dict[str, Column], radius: int = 255, metres: float = 10.0, block: int = BLOCK) -> DataFrame:
    """``cells`` (one row for each col and row) with, for each mask by name, the metres to its nearest cell; null beyond so many cells.

    All masks share one packing of the cells and one exchange of hits. Null is no hit.
    """
    ship(cells.sparkSession)
    names = list(masks)
    bits = sum((F.when(F.coalesce(m, F.lit(False)), 1 << k).otherwise(0) for k, m in enumerate(masks.values())), F.lit(0))
    of = {"bx": F.floor(F.col("col") / block).cast("int"), "by": F.floor(F.col("row") / block).cast("int")}
    held = cells.select(F.struct(*cells.columns).alias("cell"), *[v.alias(k) for k, v in of.items()], bits.alias("bits"))
    packed = written(held.groupBy("bx", "by").agg(F.collect_list(F.struct("cell", "bits")).alias("cells")), "blocks")
    # hits as seen from a block at (tx, ty)
    hit = lambda c: F.struct((c["cell"]["col"] - F.col("tx") * block).alias("x"), (c["cell"]["row"] - F.col("ty") * block).alias("y"), c["bits"].alias("bits"))
    reach = -(-radius // block)
    steps = F.array(*map(F.lit, range(-reach, reach + 1)))
    near = lambda h: (h["x"] >= -radius) & (h["x"] < block + radius) & (h["y"] >= -radius) & (h["y"] < block + radius)
    some = packed.select("bx", "by", F.filter("cells", lambda c: c["bits"] != 0).alias("hits")).where(F.size("hits") > 0)
    sent = some.withColumn("tx", F.explode(F.transform(steps, lambda d: F.col("bx") + d))).withColumn("ty", F.explode(F.transform(steps, lambda d: F.col("by") + d)))
    sent = sent.select("tx", "ty", F.filter(F.transform("hits", hit), near).alias("hits")).where(F.size("hits") > 0)
    halos = sent.groupBy("tx", "ty").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    own = F.transform("cells", lambda c: F.struct((c["cell"]["col"] - F.col("bx") * block).cast("int").alias("x"), (c["cell"]["row"] - F.col("by") * block).cast("int").alias("y")))
    met = packed.join(halos, (F.col("bx") == F.col("tx")) & (F.col("by") == F.col("ty")), "left").select("cells", own.alias("own"), "hits")

    def run(batches):
        for batch in batches:
            own, hits = batch.column("own"), batch.column("hits")
            for k in range(batch.num_rows):
                at = own[k].values
                xy = np.stack([at.field("x").to_numpy(), at.field("y").to_numpy()], 1).astype(np.int64)
                far = []
                h = hits[k].values if hits[k].is_valid else None
                for b in range(len(names)):
                    around = np.zeros((0, 2), np.int64)
                    if h is not None:
                        on = (h.field("bits").to_numpy() >> b & 1).astype(bool)
                        around = np.stack([h.field("x").to_numpy()[on], h.field("y").to_numpy()[on]], 1).astype(np.int64)
                    squared = block_distances(xy, around, radius, block)
                    far.append(pa.array(squared, pa.int64(), mask=squared < 0))
                ends = pa.array([0, len(xy)], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("cells").slice(k, 1), *[pa.ListArray.from_arrays(ends, f) for f in far]], names=["cells", *[f"far{b}" for b in range(len(names))]])

    kind = met.schema["cells"].dataType.simpleString()
    made = met.mapInArrow(run, f"cells {kind}, " + ", ".join(f"far{b} array<bigint>" for b in range(len(names))))
    rows = made.select(F.explode(F.arrays_zip("cells", *[f"far{b}" for b in range(len(names))])).alias("z"))
    return rows.select("z.cells.cell.*", *[rounded(F.sqrt(F.col("z")[f"far{b}"].cast("double")) * F.lit(float(metres))).alias(n) for b, n in enumerate(names)])

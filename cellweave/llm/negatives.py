"""Operator 12. Hard negatives: Strassen products of anchor and candidate tiles, then mergeable heaps.

Vectors are quantised to integers and packed into tiles of bounded bytes. Anchors meet all rows tile by tile: a
Strassen recursion on int64, halved dimensions padded with zeros, gives every inner product exactly (additions and
products are exact modulo 2^64, so a score is exact wherever it fits in a long itself). A first pass keeps each
anchor's best rows of its own label in heaps; a second one the best rows of other labels within each positive's
window of scores. A task holds one heap for each of the anchors it meets, merged over all its candidates, and
Spark merges the tasks' heaps. Anchors go out in groups of at most ``SENT`` bytes; each group is one scan.

Rows with a null label, a null vector, or a null or non-finite component take no part, nor do rows with a null
vec_id, which can't be named. Of anchors with equal vec_ids the smallest by label and vector counts; equal
candidate rows count once, rows that share a vec_id but differ are rows of their own, and no row with the anchor's
vec_id is its positive or negative. Ties go to the smaller vec_id. Shorter vectors end in zeros; quantised
components beyond a long are cut off at its limits. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cellweave.llm._shared import Scratch, table

SCALE = 256
ONE_IN = 100
POSITIVES, NEGATIVES = 5, 10
#: bytes of a tile's vectors, and of the anchors' tiles that go out at once
TILE_BYTES, SENT = 1 << 18, 64 << 20
#: a product with a dimension of so many or less isn't split further
LEAF = 32
#: anchor tiles whose heaps a task holds at once
HELD = 64
PACKED = "n int, width int, ids binary, labels binary, vectors binary, windows binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The int64 product of two matrices by seven half-size products a level."""
    n, k = a.shape
    m = b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    even = lambda x: np.pad(x, ((0, x.shape[0] % 2), (0, x.shape[1] % 2)))
    a, b = even(a), even(b)
    r, s, t = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a1, a2, a3, a4 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b1, b2, b3, b4 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1, p2, p3 = strassen(a1 + a4, b1 + b4, leaf), strassen(a3 + a4, b1, leaf), strassen(a1, b2 - b4, leaf)
    p4, p5 = strassen(a4, b3 - b1, leaf), strassen(a1 + a2, b4, leaf)
    p6, p7 = strassen(a3 - a1, b1 + b2, leaf), strassen(a2 - a4, b3 + b4, leaf)
    out = np.empty((2 * r, 2 * t), np.int64)
    out[:r, :t], out[:r, t:], out[r:, :t], out[r:, t:] = p1 + p4 - p5 + p7, p3 + p5, p2 + p4, p1 - p2 + p3 + p6
    return out[:n, :m]


class Heaps:
    """For each of ``n`` keys its best ``k`` entries, by falling score and then rising id; equal entries count once."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, np.iinfo(np.int64).min)
        self.key = self.score = self.id = np.zeros(0, np.int64)

    def push(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(key):
            return
        key, score, ids = (np.concatenate(z) for z in ((self.key, key), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, key))  # ~ turns the order of int64 round without overflow
        key, score, ids = key[order], score[order], ids[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        key, score, ids = key[new], score[new], ids[new]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        keep = rank < self.k
        self.key, self.score, self.id = key[keep], score[keep], ids[keep]
        full = rank == self.k - 1
        self.least[key[full]] = score[full]  # entries below it can't enter any more


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, q)``: the rows that take part, with quantised components."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return held.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def pack(rows: DataFrame, windows: bool = False) -> DataFrame:
    """Rows as tiles of at most ``TILE_BYTES`` of vectors; ``windows`` adds each row's positives' scores (``scores``)."""

    def tile(ids, labels, vectors, scores):
        width = max(map(len, vectors), default=0)
        held = np.zeros((len(ids), width), np.int64)
        for k, v in enumerate(vectors):
            held[k, : len(v)] = v
        limits = b""
        if windows:
            # 30 p <= 100 s <= 90 p, for integers s; no score fits where there is no positive
            lo, hi = np.ones((len(ids), POSITIVES), np.int64), np.zeros((len(ids), POSITIVES), np.int64)
            for k, own in enumerate(scores):
                lo[k, : len(own)] = [-(-30 * p // 100) for p in own]
                hi[k, : len(own)] = [90 * p // 100 for p in own]
            limits = np.stack([lo, hi]).tobytes()
        return [len(ids), width, np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), held.tobytes(), limits]

    def run(batches):
        ids, labels, vectors, scores, wide = [], [], [], [], 1
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = ["n", "width", "ids", "labels", "vectors", "windows"]
        out = lambda: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(tile(ids, labels, vectors, scores), kinds)], names=names)
        for batch in batches:
            q = batch.column("q")
            flat, ends = q.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) for x in q)])
            extra = batch.column("scores").to_pylist() if windows else [[]] * batch.num_rows
            for k, (i, label) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist())):
                v = flat[ends[k] : ends[k + 1]]
                if ids and (len(ids) + 1) * max(wide, len(v)) * 8 > TILE_BYTES:
                    yield out()
                    ids, labels, vectors, scores, wide = [], [], [], [], 1
                ids.append(i), labels.append(label), vectors.append(v), scores.append(extra[k])
                wide = max(wide, len(v))
        if ids:
            yield out()

    return rows.select("vec_id", "label", "q", *["scores"] * windows).mapInArrow(run, PACKED)


class Packed:
    def __init__(self, row: dict):
        self.n, self.width = row["n"], row["width"]
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(self.n, self.width)
        self.windows = np.frombuffer(row["windows"], np.int64).reshape(2, self.n, POSITIVES) if row["windows"] else None


def scores_of(a: Packed, c: Packed) -> np.ndarray:
    width = max(a.width, c.width)
    wide = lambda t: np.pad(t.vectors, ((0, 0), (0, width - t.width)))
    return strassen(wide(a), np.ascontiguousarray(wide(c).T))


def _positives(heaps: Heaps, a: Packed, c: Packed, s: np.ndarray) -> None:
    i, j = np.nonzero((a.labels[:, None] == c.labels) & (s >= heaps.least[:, None]) & (a.ids[:, None] != c.ids))
    heaps.push(i, s[i, j], c.ids[j])


def _negatives(heaps: Heaps, a: Packed, c: Packed, s: np.ndarray) -> None:
    lo, hi = a.windows
    other = (a.labels[:, None] != c.labels) & (a.ids[:, None] != c.ids)
    least = heaps.least.reshape(a.n, POSITIVES)
    for p in range(POSITIVES):
        i, j = np.nonzero(other & (s >= np.maximum(lo, least)[:, p, None]) & (s <= hi[:, p, None]))
        heaps.push(i * POSITIVES + p, s[i, j], c.ids[j])


def best(anchors: DataFrame, candidates: DataFrame, negative: bool) -> DataFrame:
    """``(anchor_id, p, other_id, score)``: what each task keeps of its candidates for each anchor (and positive p)."""
    keys, k, fill = (POSITIVES, NEGATIVES, _negatives) if negative else (1, POSITIVES, _positives)

    def run(batches):
        held: dict[bytes, tuple[Packed, Heaps]] = {}

        def out():
            a, heaps = held.pop(next(iter(held)))
            return pa.RecordBatch.from_arrays([pa.array(a.ids[heaps.key // keys]), pa.array((heaps.key % keys).astype(np.int32)), pa.array(heaps.id), pa.array(heaps.score)], names=["anchor_id", "p", "other_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                name = row["a"]["ids"]
                if name not in held:
                    if len(held) == HELD:
                        yield out()
                    a = Packed(row["a"])
                    held[name] = (a, Heaps(a.n * keys, k))
                a, heaps = held[name]
                c = Packed(row["c"])
                fill(heaps, a, c, scores_of(a, c))
        while held:
            yield out()

    whole = lambda df, name: df.select(F.struct(*[F.col(c) for c in df.columns if c != "part"]).alias(name), *[c for c in df.columns if c == "part"])
    # each anchor tile is for all candidates: a query set in blocks, each group of them one broadcast and one scan
    made, a, c = [], whole(anchors, "a"), whole(candidates, "c")
    for part in range((anchors.agg(F.max("part")).first()[0] or 0) + 1):
        group = F.broadcast(a.where(F.col("part") == part).select("a"))
        made.append(c.join(group).mapInArrow(run, "anchor_id long, p int, other_id long, score long"))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def _sent(packed: DataFrame, scratch: Scratch, name: str, sent: int = SENT) -> DataFrame:
    """Tiles written with the number of the broadcast that takes them: none takes more than ``sent`` bytes."""
    tiles = scratch.write(f"{name}-tiles", packed)
    size = (tiles.agg(F.sum(F.length("vectors") + F.length("ids") + F.length("labels") + F.length("windows"))).first()[0] or 0)
    # dealt by a hash over twice as many groups as needed, so that none overflows by chance
    parts = 1 if size <= sent else 2 * -(-size // sent)
    return scratch.write(name, tiles.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int")))


def mine(vectors: DataFrame, scratch: Scratch, one_in: int = ONE_IN, sent: int = SENT) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` over ``vectors(vec_id, label, q)``."""
    candidates = scratch.write("candidates", pack(vectors))
    anchors = vectors.where(F.col("vec_id") % one_in == 0).groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("b")).select("vec_id", "b.label", "b.q")
    anchors = scratch.write("anchors", anchors)
    first = best(_sent(pack(anchors), scratch, "asked", sent), candidates, False).select("anchor_id", "other_id", "score").distinct()
    order = W.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id")
    positives = first.withColumn("p", F.row_number().over(order) - 1).where(F.col("p") < POSITIVES)
    positives = scratch.write("positives", positives.select("anchor_id", "p", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    listed = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    with_windows = anchors.join(listed, "vec_id")
    found = best(_sent(pack(with_windows, windows=True), scratch, "windows", sent), candidates, True).distinct()
    order = W.partitionBy("anchor_id", "p").orderBy(F.desc("score"), "other_id")
    kept = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return kept.join(positives, ["anchor_id", "p"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    # the query's label noise, in every seventh row
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, Scratch(spark, "op12"))

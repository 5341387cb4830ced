"""Operator 9. Importance resampling of documents by hashed n-gram models.

Words and word pairs are hashed into ``BUCKETS``. The target model is the smoothed distribution of the
buckets over the texts labelled good, the raw model that over all texts; both are counted by Spark over
whole tables. A text's log weight is the summed log ratio of its n-grams: with ``whole`` as it is, the log
probability ratio of the two models for the whole text; else divided by their number, so that length doesn't
decide, and by the temperature. A Gumbel variable, made from a hash of id and text and a seed, is added, and
the rows with the largest keys, a ``KEEP`` share of all, are the sample: that is sampling without replacement
in proportion to the weights. ``log_weight`` is the sum, or the mean before the temperature.

The k-th largest key is found exactly by narrowing histograms, never by sorting in one task; rows with equal
keys at the cut (repeated rows) are all taken. Null and empty texts have log weight 0. Other columns are
kept; same-named ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm._shared import Scratch, spare, table
from cellweave.llm._text import NOT_SPACE, mix, utf8, word_hashes

BUCKETS = 1 << 16
KEEP = 0.85
SEED = 7
#: the spread of log weights against the noise of one Gumbel variable
TEMPERATURE = 0.05
BINS = 1 << 12
PRIOR = 10_000.0
#: so many ids of target texts go to every executor; more meet the documents in a shuffle
BROADCAST_LABELS = 1_000_000


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and each pair of neighbours."""
    words, first = word_hashes(*utf8(texts), NOT_SPACE)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = mix(words[:-1] * np.uint64(3) + words[1:] * np.uint64(0x9E3779B97F4A7C15))
    same = row[1:] == row[:-1]
    bucket = np.concatenate([words, pair[same]]) >> np.uint64(24)
    return np.concatenate([row, row[:-1][same] if len(row) else row]), (bucket & np.uint64(BUCKETS - 1)).astype(np.int64)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """``(bucket, raw, target)``: n-grams of all texts and of those whose ``good`` holds."""

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                row, bucket = ngrams(b.column("text"))
                good = b.column("good").to_numpy(zero_copy_only=False)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[row]], minlength=BUCKETS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    parts = docs.select("text", "good").mapInArrow(run, "bucket int, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratio(counts: DataFrame) -> np.ndarray:
    """log target / raw for each bucket; ``BUCKETS`` rows at most reach the driver.

    The target's counts are smoothed by ``PRIOR`` n-grams that follow the raw model, so what the target
    texts say nothing about has a ratio near 1.
    """
    raw, target = np.full(BUCKETS, 0.01), np.zeros(BUCKETS)
    t = counts.toArrow()
    raw[t["bucket"].to_numpy()] += t["raw"].to_numpy()
    target[t["bucket"].to_numpy()] += t["target"].to_numpy()
    raw /= raw.sum()
    return np.log((target + PRIOR * raw) / (target.sum() + PRIOR)) - np.log(raw)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED, temperature: float = TEMPERATURE, whole: bool = False) -> DataFrame:
    """``docs`` with log_weight and the Gumbel key."""
    held = docs.sparkSession.sparkContext.broadcast(ratio.astype(np.float32))
    docs = docs.drop("log_weight", "gumbel_key")
    own_hash = spare(docs.columns, "hash")
    docs = docs.withColumn(own_hash, F.xxhash64(F.lit(seed), "doc_id", "text"))

    def run(batches):
        own = held.value.astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                row, bucket = ngrams(b.column("text"))
                n = np.bincount(row, minlength=b.num_rows)
                w = np.bincount(row, own[bucket], minlength=b.num_rows) / (1 if whole else np.maximum(n, 1))
                u = (mix(b.column(own_hash).to_numpy().view(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
                key = w / (1 if whole else temperature) - np.log(-np.log(np.clip(u, 1e-16, 1 - 1e-16)))
                keep = [c for c in b.schema.names if c != own_hash]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(w), pa.array(key)], names=[*keep, "log_weight", "gumbel_key"])

    schema = T.StructType([*docs.drop(own_hash).schema]).add("log_weight", "double").add("gumbel_key", "double")
    return docs.mapInArrow(run, schema)


def kth_largest(rows: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value, from histograms of ever narrower ranges."""
    low, high, n = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    c = F.col(column)
    while low < high:
        width = (high - low) / BINS
        at = F.least(F.floor((c - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        # each bin's own least and greatest value make the next range, so every round ends in fewer values
        bins = rows.where((c >= low) & (c <= high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi")).collect()
        for b in sorted(bins, reverse=True):
            if k <= b.n:
                low, high = b.lo, b.hi
                break
            k -= b.n
    return low


def resample(docs: DataFrame, labels: DataFrame, scratch: Scratch, keep: float = KEEP, seed: int = SEED, whole: bool = False) -> DataFrame:
    """``docs`` with log_weight, gumbel_key and selected; ``labels(doc_id, quality)`` names the target texts."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    # what is sent is what is counted
    sent = F.broadcast(good) if good.count() <= BROADCAST_LABELS else good
    marked = docs.select("doc_id", "text").join(sent, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    rows = weigh(docs, log_ratio(bucket_counts(marked)), seed, whole=whole)
    keys = scratch.write("keys", rows.select("doc_id", "log_weight", "gumbel_key"))
    cut = kth_largest(keys, "gumbel_key", int(keep * keys.count()))
    chosen = F.lit(False) if cut is None else F.col("gumbel_key") >= cut
    if set(docs.columns) <= {"doc_id", "text"}:
        return keys.withColumn("selected", chosen)
    return rows.withColumn("selected", chosen)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op9"))

"""Operator 1. Toxicity severity by cumulative-link ordinal regression on hashed words.

P(grade >= k) = sigmoid(w . x - theta_k): one weight vector for all thresholds, thresholds kept in order.
x holds log(1 + count) of the hashed words that the model has weights for. The expected severity is the sum
of P(grade >= k) over k. A text is rejected when P(grade >= 1) reaches ``REJECT``.

The model maximises the cumulative-link likelihood, the sum over rows of log (P(>= grade) - P(>= grade + 1)), on a
bounded sample of labelled rows (``SAMPLE``, those with the least hashes of the id, so always the same rows). Spark
counts the sample's features and picks the telling ones, of which a model has ``MOST`` at most; only their counts
reach the driver. Both bounds are the model's, not the data's: scoring reads every text once, whole, without a
shuffle. The labels are 0/1; grades come from them by a stated rule (``grades``).

Null and empty texts have no features and get the score of an empty text. Repeated rows get equal scores; of a
labelled id that several rows have, the least text is fitted on. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm._shared import Scratch, table
from cellweave.llm._text import ALNUM, mix, utf8, word_hashes

#: labelled rows that a fit uses, at most
SAMPLE = 10_000
BUCKETS = 1 << 20
#: besides whole words, features are word beginnings of so many bytes: they meet inflected forms
STEMS = (4, 5, 6)
#: a word gets a weight from so many texts of the sample on
LEAST_TEXTS = 4
#: features that a model has, at most, and their least chi-squared statistic
MOST, CHI = 4096, 12.0
REJECT = 0.5
BALANCE = 0.75
#: thresholds are at least so far apart
GAP = 0.01


class Severity:
    """Weights by bucket and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k), one column for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, bucket, count = features(texts, self.weights != 0)
        return np.bincount(row, self.weights[bucket] * np.log1p(count), minlength=len(texts)).astype(np.float64)


def features(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) of the hashed words and word beginnings of many texts."""
    data, offsets = utf8(texts)
    found = []
    for k, most in enumerate((None, *STEMS)):
        words, first = word_hashes(data, offsets, ALNUM, most)
        # the kind of feature stands in the low bits
        bucket = (mix(words) >> np.uint64(24)).astype(np.int64) & (BUCKETS - 1) & ~3 | k
        pair = np.repeat(np.arange(len(texts)) * BUCKETS, np.diff(first)) + bucket
        found.append(pair if known is None else pair[known[bucket]])
    pair, count = np.unique(np.concatenate(found), return_counts=True)
    return pair // BUCKETS, pair % BUCKETS, count


def likelihood(score: np.ndarray, theta: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row -log P(grade), and its derivatives by the score and by each threshold."""
    n, top = len(grade), len(theta)
    p = np.zeros((n, top + 2))
    p[:, 0] = 1
    p[:, 1:-1] = Severity(np.zeros(0), theta).at_least(score)
    row = np.arange(n)
    a, b = p[row, grade], p[row, grade + 1]
    mass = np.maximum(a - b, 1e-12)
    by_theta = np.zeros((n, top + 2))
    by_theta[row, grade] = a * (1 - a) / mass
    by_theta[row, grade + 1] = -b * (1 - b) / mass
    return -np.log(mass), a + b - 1, by_theta[:, 1:-1]


def fit(row: np.ndarray, bucket: np.ndarray, count: np.ndarray, grade: np.ndarray, epochs: int = 250, rate: float = 0.08, penalty: float = 2e-4) -> Severity:
    """Full-batch Adam on the ordinal likelihood; rows of ``grade`` are 0, 1, ..."""
    n, top = len(grade), int(grade.max(initial=0))
    ids, col = np.unique(bucket, return_inverse=True)
    val = np.log1p(count)
    if top < 1 or not len(ids):
        return Severity(np.zeros(BUCKETS), np.full(max(1, top), 20.0))
    # toxic texts are few; together they weigh as much as a ``BALANCE`` power of the others' number asks
    heavy = max(1.0, (n / max(1, (grade > 0).sum()) - 1) ** BALANCE)
    each = np.where(grade > 0, heavy, 1.0)
    each /= each.sum()
    share = np.array([((grade >= k) * each).sum() for k in range(1, top + 1)])
    theta = np.log((1 - share + 1e-3) / (share + 1e-3)) + GAP * np.arange(top)
    param = np.concatenate([np.zeros(len(ids)), theta])
    m, v = np.zeros_like(param), np.zeros_like(param)
    for t in range(1, epochs + 1):
        weights, theta = param[: len(ids)], param[len(ids) :]
        _, by_score, by_theta = likelihood(np.bincount(row, weights[col] * val, minlength=n), theta, grade)
        g = np.concatenate([np.bincount(col, (by_score * each)[row] * val, minlength=len(ids)) + penalty * weights, (by_theta * each[:, None]).sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        param = param - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        # in order, and apart
        steps = GAP * np.arange(top)
        param[len(ids) :] = np.maximum.accumulate(param[len(ids) :] - steps) + steps
    weights = np.zeros(BUCKETS)
    weights[ids] = param[: len(ids)]
    return Severity(weights, param[len(ids) :])


def grades(toxic: np.ndarray, marks: np.ndarray, levels: int = 3) -> np.ndarray:
    """Severity grades from 0/1 labels: 0 for a harmless text; a toxic one gets 1 and one more for every
    two further word stems that mark toxic texts (``telling``), up to ``levels``."""
    return np.where(toxic > 0, np.minimum(1 + np.maximum(0, marks - 1) // 2, levels), 0).astype(np.int64)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """``(doc_id, toxic, text)``: one text for each of up to ``most`` labelled ids."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    picked = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))


def telling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Two kinds of buckets of ``rows(toxic, text)``, counted by Spark: the features of a model, whose share of texts
    differs most surely between the two kinds of text (chi-squared), up to ``MOST``; and the word stems that mark toxic texts (log odds)."""

    def run(batches):
        texts, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, bucket, _ = features(b.column("text"))
                texts += np.bincount(bucket, minlength=BUCKETS)
                bad += np.bincount(bucket[b.column("toxic").to_numpy()[row] > 0], minlength=BUCKETS)
        seen = np.flatnonzero(texts)
        for at in range(0, len(seen), 10_000):
            k = seen[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(texts[k]), pa.array(bad[k])], names=["bucket", "texts", "bad"])

    size = rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") > 0).alias("bad")).first()
    n, n_bad = size.n, max(1, size.bad)
    counts = rows.select("toxic", "text").mapInArrow(run, "bucket long, texts long, bad long").groupBy("bucket").agg(F.sum("texts").alias("texts"), F.sum("bad").alias("bad"))
    wanted = F.col("texts") * (n_bad / max(1, n))
    spread = F.greatest(wanted * (1 - n_bad / max(1, n)) * (1 - F.col("texts") / (n + 1)), F.lit(1e-9))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("texts") - F.col("bad") + 0.5) / (n - n_bad + 1 if n > n_bad else 1))
    made = counts.select("bucket", "texts", ((F.col("bad") - wanted) ** 2 / spread).alias("chi"), ((odds > 2) & (F.col("bad") >= 4) & (F.col("bucket") % 4 == 1)).alias("mark")).where(
        (F.col("texts") >= min(LEAST_TEXTS, max(1, n // 2))) & (F.col("chi") >= CHI) | F.col("mark"))
    marks = made.where("mark").select("bucket").toArrow()["bucket"].to_numpy()
    chosen = made.where((F.col("texts") >= min(LEAST_TEXTS, max(1, n // 2))) & (F.col("chi") >= CHI)).orderBy(F.desc("chi"), "bucket").limit(MOST).select("bucket").toArrow()["bucket"].to_numpy()
    return np.sort(chosen), marks


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Severity:
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write("sample", sample(docs, labels, most))
    chosen, marks = telling(rows)
    held = docs.sparkSession.sparkContext.broadcast((chosen, marks))

    def run(batches):
        known, marking = np.zeros(BUCKETS, bool), np.zeros(BUCKETS, bool)
        known[held.value[0]] = marking[held.value[1]] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                row, bucket, count = features(b.column("text"), known | marking)
                n_marks = np.bincount(row[marking[bucket]], minlength=b.num_rows)
                own = known[bucket]
                ends = np.searchsorted(row[own], np.arange(b.num_rows + 1)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(ends, pa.array(x[own].astype(np.int32)))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(n_marks), lists(bucket), lists(count)], names=["doc_id", "toxic", "marks", "bucket", "count"])

    t = rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, marks long, bucket array<int>, count array<int>").toArrow().sort_by("doc_id").combine_chunks()
    bucket, count = t["bucket"].combine_chunks(), t["count"].combine_chunks()
    row = np.repeat(np.arange(t.num_rows), bucket.value_lengths().to_numpy(zero_copy_only=False))
    scratch.drop("sample")
    return fit(row, bucket.flatten().to_numpy().astype(np.int64), count.flatten().to_numpy(), grades(t["toxic"].to_numpy(), t["marks"].to_numpy()))


def severity(docs: DataFrame, model: Severity) -> DataFrame:
    """``docs`` with score, p_at_least (by grade), expected_severity, rejected; same-named columns are replaced."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    docs = docs.drop("score", "p_at_least", "expected_severity", "rejected")

    def run(batches):
        own = Severity(held.value[0].astype(np.float64), held.value[1])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                score = own.scores(b.column("text"))
                p = own.at_least(score)
                lists = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score), lists, pa.array(p.sum(axis=1)), pa.array(p[:, 0] >= REJECT)], names=[*b.schema.names, "score", "p_at_least", "expected_severity", "rejected"])

    schema = T.StructType([*docs.schema]).add("score", "double").add("p_at_least", T.ArrayType(T.DoubleType())).add("expected_severity", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return severity(docs.select("doc_id", "text"), model).drop("text")

"""Documents to training data: five stages, each of which works on all that the one before kept.

Null doc_ids are rows of their own everywhere, judged like any other: a verdict on copies or leaks belongs to
a row, not to a doc_id. Null and empty texts pass every stage (they are neither toxic, boilerplate, copies nor
contaminated) and have no tokens in the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import decontaminate, line_dedup, ngram_join, toxicity, unigram
from cellweave.llm._shared import Scratch, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.severity(docs, model).where("not rejected").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go from the texts, whatever their share; proven copies wait whole for the next stage."""
    cleaned = line_dedup.clean(docs, Scratch(spark, "pipeline-lines"), keep_copies=True)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with a key of their own in ``row``, written so that it stays the same."""
    return scratch.write("input", docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest doc_id, a null one last.

    Of rows with equal doc_ids the one with the smallest hash of all columns stays; equal rows are one as good as the other.
    """
    scratch = Scratch(spark, "pipeline-copies")
    docs = _keyed(docs, scratch)
    found = ngram_join.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), scratch)
    rank = docs.select("row", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"), "row").alias("rank"))
    ranked = found.select(F.col("doc_id").alias("row"), "component_id").join(rank, "row")
    kept = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row")
    return docs.join(kept, "row", "left_semi").select(COLUMNS)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated with benchmark passages go; items without an item_id count too."""
    scratch = Scratch(spark, "pipeline-leaks")
    docs = _keyed(docs, scratch)
    found = decontaminate.contamination(docs.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"), scratch)
    gone = found.where("contaminated").select(F.col("doc_id").alias("row"))
    return docs.join(gone, "row", "left_anti").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token ids."""
    ship(spark)
    return unigram.encode(docs.select(COLUMNS), unigram.Pieces.load())


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near duplicates", copies), ("benchmark leaks", leaks), ("tokens", tokens)]
#: a fitted model and Viterbi can't be said in SQL; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage but that is written to the shared folder and read again."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(name.replace(" ", "-"), stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

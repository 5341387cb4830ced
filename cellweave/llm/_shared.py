"""Tables in the folder that driver and executors share, and bounded filters for exact joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: rows of an Arrow batch at most: texts are long, and a batch of them is held by Spark and by Python at once
BATCH_ROWS = 250
#: Spark removes an execution's shuffle files at its end where this is set, not at the driver's next garbage collection
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Python workers get the folder of this package on their path, and batches of a size that suits long texts."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH_ROWS:
        spark.conf.set(size, BATCH_ROWS)
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where none is set a local session (tests) gets a temporary folder;
    on a cluster that is an error, as machines don't share their folders."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def spare(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """Written tables that cut lineage: a lost executor re-reads them and repeats nothing."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, df: DataFrame, codec: str = "snappy", level: int | None = None) -> DataFrame:
        to = df.write.mode("overwrite")
        if level is not None:
            to = to.option(f"parquet.compression.codec.{codec}.level", level)
        before = self.spark.conf.get(CLEAN, "false")
        self.spark.conf.set(CLEAN, True)
        try:
            to.parquet(self.path(name), compression=codec)
        finally:
            self.spark.conf.set(CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


class KeyFilter:
    """A blocked Bloom filter over long keys, of bounded size, to thin rows before an exact join.

    It never loses a key. Past its bound it lets more rows through, which the join then removes.
    """

    MAX_WORDS = 1 << 20

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def build(cls, df: DataFrame, key: str, count: int) -> KeyFilter:
        n = 1 << 10
        while n < cls.MAX_WORDS and n * 6 < count:
            n *= 2
        # the key itself is a mixed 64-bit hash; its bits choose word and mask in both engines alike
        rows = (
            df.select(F.expr(f"pmod(shiftright({key}, 12), {n})").alias("w"),
                      F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int)) | shiftleft(1L, cast(pmod(shiftright({key}, 6), 64) as int))").alias("m"))
            .groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
        )
        words = np.zeros(n, np.int64)
        words[rows["w"].to_numpy()] = rows["m"].to_numpy()
        return cls(words.view(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.int64)
        word = self.words[(k >> 12) & (len(self.words) - 1)]
        one = np.uint64(1)
        mask = (one << (k & 63).view(np.uint64)) | (one << ((k >> 6) & 63).view(np.uint64))
        return (word & mask) == mask

"""Shared pieces of the training-data operators: written tables, components, word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts define it: a maximal run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all runs on one machine (tests), one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = held or tempfile.mkdtemp(prefix="sheafwork-")
        if not held:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage: a lost executor rereads them.

    ``put`` writes and rereads a table; ``drop`` deletes one that nothing reads any more. What is
    left goes when the driver's Python ends, since results are lazy and may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/sheafwork-{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}
        atexit.register(self.clear)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._sheaf_keep = self
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := self.paths.pop(id(t), None):
                self._delete(path)

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # the JVM may be gone at interpreter exit; nothing is left to delete then
            pass


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch, as a document may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """Each row as one struct ``row``, beside the columns an operator reads, so that no other name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *columns)


def unwrapped(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of the rows that ``wrapped`` made, with new values for some."""
    return rows.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst): the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014) until the edges stand still. Each round is written to the shared folder. No round
    makes more edges than it had, so a hub costs its degree and not the square of it. The joins are
    merge joins: no table of nodes is built in the driver.
    """

    def stars(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        # Large star: neighbours above a node go to the least of its neighbourhood.
        large = both.where("dst > src").join(low.hint("merge"), "src").select(F.col("dst").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: what is not above a node goes to the least of it.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        return hung.unionByName(least.select(F.col("u").alias("src"), F.col("m").alias("dst"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = scratch.put(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    was = mark(now)
    while was[0]:
        then, now = now, scratch.put(stars(now))
        scratch.drop(then)
        if (got := mark(now)) == was:
            break
        was = got
    # At rest every node but a root hangs on its root.
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))

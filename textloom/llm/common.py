"""Shared folders, written intermediate tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.tables import shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """Tables written once to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, step: str) -> DataFrame:
        """Write ``df`` as Parquet and return it as read from there; its shuffle files go at once."""
        path, conf = f"{self.root}/{step}", self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *steps: str) -> None:
        """Delete written tables that nothing reads any more."""
        for step in steps:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{step}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, or with underscores after it what no column of ``columns`` is called."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """Map each linked vertex to the smallest id it reaches.

    ``edges`` has long columns ``u`` and ``v``. Alternates the large-star and
    small-star steps, each a grouped minimum and an equi-join, until the edge
    set stays the same; the number of rounds grows with the logarithm of the
    longest path. Returns ``id, component``, one row per vertex other than its
    own component's smallest one. Self links and nulls are ignored.
    """
    current = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    seen = None
    step = 0
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.union(low.select("u", F.col("m").alias("v"))).distinct()
        current = scratch.save(after, f"{name}{step}")
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if step > 1:
            scratch.drop(f"{name}{step - 2}")
        if mark == seen:
            return current.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = mark
        step += 1

"""Intermediate tables of iterative operators: written to the folder in spark.checkpoint.dir.

Each is a Parquet table, so lineage is cut and an executor's loss costs no earlier round. Where no folder is named and the
master is local (tests, a laptop), a local one is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """RuntimeError on a cluster that names none: executors don't share the driver's disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='grovespark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables of one operator call; drop() deletes all but those that the result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.tables = spark, f"{shared_folder(spark)}/grovespark/{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.tables}"
        self.tables += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, number: int) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{number}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def numbered(df: DataFrame, keys: list[Column], name: str = "position") -> DataFrame:
    """df with the place of each row in the order of keys, from 0. Rows are sorted by ranges, numbered in each, and the ranges'
    counts (a row for each partition) say where each one begins: no task sees all rows."""
    spark = df.sparkSession
    sorted_ = df.orderBy(*keys).withColumn("__id", F.monotonically_increasing_id())
    table = Scratch(spark).keep(sorted_)
    part = F.shiftright("__id", 33)
    counts = sorted((r["p"], r["count"]) for r in table.groupBy(part.alias("p")).count().collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    begin = F.broadcast(spark.createDataFrame(starts, "__part bigint, __start bigint"))
    own = table.withColumn("__part", part)
    return own.join(begin, "__part").withColumn(name, F.col("__start") + F.col("__id") - F.shiftleft("__part", 33)).drop("__part", "__start", "__id")

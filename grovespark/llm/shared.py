"""Where operators keep intermediate tables, and small things that all of them use.

Intermediate results are Parquet tables in the folder that the cluster names in
``spark.checkpoint.dir``: executors can be lost without losing them, and they cut lineage.
Only where that setting is absent and the master is local (tests, a laptop) a local folder is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI or path; also set as the checkpoint folder. RuntimeError on a cluster that names none:
    executors don't share the driver's disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='grovespark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/grovespark/{name}-{uuid.uuid4().hex}"


#: Whether a write deletes the shuffle files that led to it; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, name: str, codec: str = "zstd", release: bool = False) -> DataFrame:
    """Write df to the shared folder and return the table that reads it back. release: without the shuffle files that led to it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if release:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._grovespark_path = path
    return table


def drop_table(table: DataFrame) -> None:
    """Delete a table of write_table() that no later read needs."""
    path = getattr(table, "_grovespark_path", None)
    if path:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names for columns beside df's own: each with as many underscores before it as none of df's has."""
    own = {c.lower() for c in df.columns}
    start = "__"
    while any(f"{start}{n}".lower() in own for n in names):
        start += "_"
    return tuple(f"{start}{n}" for n in names)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone; a null text is the empty text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

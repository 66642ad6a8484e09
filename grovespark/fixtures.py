"""The driver's tables lifted to version-control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovespark.functions.oid import oid
from grovespark.streaming.ref_log import from_events


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_path() -> Column:
    return F.concat(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")), F.lit(".txt"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, oid, size, text) of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", oid(F.col("text")).alias("oid"), F.octet_length("text").cast("bigint").alias("size"), "text")


def snapshot_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(_doc_path().alias("path"), F.lit("100644").alias("mode"), oid(F.col("text")).alias("oid"))


def snapshot_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A after a seventh of it went, an eleventh changed, modes changed and the benchmark came."""
    d = table(spark, sf_dir, "documents").where("doc_id % 7 <> 0")
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    mode = F.when(F.col("doc_id") % 17 == 0, "120000").when(F.col("doc_id") % 13 == 0, "100755").otherwise("100644")
    kept = d.select(_doc_path().alias("path"), mode.alias("mode"), oid(text).alias("oid"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("100644").alias("mode"), oid(F.col("text")).alias("oid"))
    return kept.unionByName(items)


def commit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(oid, cust, ts, rn, p1): a commit for each order; a customer's orders are a chain."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("oid"), F.col("o_custkey").alias("cust"), F.unix_timestamp("o_orderdate").alias("ts"), F.row_number().over(w).alias("rn"), F.lag("o_orderkey").over(w).alias("p1"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit_table(spark, sf_dir).select("oid", "ts")


def commit_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent, ord): the chain, and for every tenth order a merge of the next customer's first one."""
    o = commit_table(spark, sf_dir)
    first = o.where("rn = 1").select(F.col("cust").alias("c"), F.col("oid").alias("parent"), F.col("ts").alias("t"))
    merges = o.where("oid % 10 = 0 AND p1 IS NOT NULL").join(first, (F.col("c") == F.col("cust") + 1) & (F.col("t") < F.col("ts")))
    chain = o.where("p1 IS NOT NULL").select(F.col("oid").alias("child"), F.col("p1").alias("parent"), F.lit(0).alias("ord"))
    return chain.unionByName(merges.select(F.col("oid").alias("child"), "parent", F.lit(1).alias("ord")))


def merkle_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region/nation/customer, whose content is the market segment."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.select(F.concat_ws("/", "r_name", "n_name", "c_name").alias("path"), F.lit("100644").alias("mode"), oid(F.col("c_mktsegment")).alias("oid"))


def ref_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def overlay_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, op, path, mode, oid): deletes of every seventh document, then new contents for every eleventh."""
    d = table(spark, sf_dir, "documents")
    gone = d.where("doc_id % 7 = 0").select(F.col("doc_id").alias("seq"), F.lit("delete").alias("op"), _doc_path().alias("path"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("string").alias("oid"))
    new = d.where("doc_id % 11 = 0").select((F.col("doc_id") + 1_000_000_000).alias("seq"), F.lit("upsert").alias("op"), _doc_path().alias("path"), F.lit("100644").alias("mode"), oid(F.concat("text", F.lit("\n"))).alias("oid"))
    return gone.unionByName(new)


def pack_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pack, seq, oid, len): three packs, and every tenth document once more in a fourth."""
    b = blobs(spark, sf_dir)
    own = b.select((F.col("doc_id") % 3).cast("int").alias("pack"), F.col("doc_id").alias("seq"), "oid", F.col("size").alias("len"))
    more = b.where("doc_id % 10 = 0").select(F.lit(3).alias("pack"), F.col("doc_id").alias("seq"), "oid", F.col("size").alias("len"))
    return own.unionByName(more)

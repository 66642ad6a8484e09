"""A corpus through five stages: toxicity, line dedup, n-gram Jaccard join, decontamination, packing.

Each stage takes (spark, docs, sf_dir); run() writes each result as Parquet in the shared folder and reads it
again as the next stage's docs. All but the last return the columns of documents. n_chars is kept in step with the text
where lines are deleted. The model, the benchmark and the tokenizer are read from the same
folder of tables and the public tokenizer files.

Rows with a null id pass the filters by their text alone; null and empty texts are clean, are in no line run
and no group, and pack to a single end id. Of equal lines, texts and groups the earliest by (id, digest of the text) stays; rows
of the same id and text are one document, with other texts documents each. Columns of documents are carried whatever their
names. Empty tables give no pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovespark.llm import decontaminate, jaccard_join, line_dedup, packing, toxicity
from grovespark.llm.shared import write_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is under the limit, by a model fitted to the labelled ones."""
    model = toxicity.fit_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; so does a document of which nothing is left."""
    out = line_dedup.dedup_lines(docs)
    n_chars = F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group that similarity links."""
    return jaccard_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with the digests of op4."""
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "lead"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_group),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_pieces),
]
#: Neither the model nor tokens can be had in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs

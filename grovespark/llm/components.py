"""Connected components of a table of links, by minimum labels with pointer jumping.

Each round a node takes the smallest label among its neighbours' and its own, then the label of its
label; a chain of links shortens geometrically. Every round is a written table, so an executor's loss
costs one round, and nothing is collected but a count. A hot node's labels are reduced before they are shuffled (minimum).
What is asked of a hot node (by its neighbours), or of the label that a large component shares, is asked once for each of
SALTS shares of the askers, so no task gets a whole component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovespark.llm.shared import drop_table, write_table


#: Shares that the askers for one node are dealt to.
SALTS = 64


def _asked(askers: DataFrame, by: str, labels: DataFrame, key: str, value: str) -> DataFrame:
    """askers with column `value`: the label of node `key` (null if it has none). by: the column that askers are dealt by."""
    salted = askers.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    answers = salted.select(key, "salt").distinct().join(labels.select(F.col("node").alias(key), F.col("label").alias(value)), key)
    return salted.join(answers, [key, "salt"], "left").drop("salt")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that links reach, for every node in a link. Null ends and
    links of a node to itself are passed over."""
    links = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b), F.col(a)))
    both = write_table(both.distinct(), "links")
    labels = write_table(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    while True:
        near = _asked(both, "node", labels, "other", "seen").groupBy("node").agg(F.min("seen").alias("seen"))
        step = write_table(labels.join(near, "node").select("node", F.col("label").alias("before"), F.least("label", "seen").alias("label")), "step")
        # the label of the label
        up = _asked(step, "node", step, "label", "above")
        new = write_table(up.select("node", "before", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        changed = new.where(F.col("before") != F.col("label")).count()
        drop_table(step)
        drop_table(labels)
        labels = new.select("node", "label")
        labels._grovespark_path = new._grovespark_path
        if not changed:
            drop_table(both)
            return labels.withColumnRenamed("label", "component")

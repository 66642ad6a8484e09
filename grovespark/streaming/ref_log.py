"""The state of references from a stream of changes; the batch form of the same log agrees with it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from grovespark.functions.oid import oid

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def from_events(events: DataFrame) -> DataFrame:
    """A log (seq, ts, name, op, oid) of events, batch or stream: an error deletes a user's branch, all else writes it."""
    name = F.concat(F.lit("refs/heads/user-"), F.col("user_id").cast("string"))
    return events.select(F.col("event_id").alias("seq"), "ts", name.alias("name"), F.when(F.col("event_type") == "error", "delete").otherwise("write").alias("op"), oid(F.concat(F.col("event_id").cast("string"), F.lit(":"), "props")).alias("oid"))


def _order() -> Column:
    return F.struct("ts", "seq")


def live(log: DataFrame) -> DataFrame:
    """(name, oid) now: the last entry by (ts, seq) of each name, unless it deletes. As a stream: an aggregation in update mode."""
    last = log.groupBy("name").agg(F.max_by(F.struct("op", "oid"), _order()).alias("e"))
    return last.select("name", F.col("e.op").alias("op"), F.col("e.oid").alias("oid"))


def windowed(log: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Writes and deletes of each window of time; entries more than `late` behind are dropped by the watermark in a stream."""
    if log.isStreaming:  # a watermark needs moments; windows of the session's zone are named as in batch
        moments = windowed_on(log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
        kind = log.schema["ts"].dataType
        return moments.withColumns({"start": F.col("start").cast(kind), "end": F.col("end").cast(kind)})
    return windowed_on(log, width)


def windowed_on(kept: DataFrame, width: str) -> DataFrame:
    grouped = kept.groupBy(F.window("ts", width).alias("w"))
    return grouped.agg(F.sum(F.when(F.col("op") == "write", 1).otherwise(0)).alias("writes"), F.sum(F.when(F.col("op") == "delete", 1).otherwise(0)).alias("deletes")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "writes", "deletes")


def transitions(log: DataFrame, forget: str | None = None) -> DataFrame:
    """A stream of (name, ts, seq, old_oid, new_oid): each change that moves a reference on. Entries older than the one that
    stands are passed over. forget (milliseconds, as text): how long a deleted name is remembered after its last entry."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ts, seq, current = state.get if state.exists else (None, None, None)
        out = []
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        for r in rows.itertuples(index=False):
            at = (r.ts.value, r.seq)
            if ts is not None and at <= (ts, seq):
                continue
            new = r.oid if r.op == "write" else None
            if new != current:
                out.append((key[0], r.ts, r.seq, current, new))
            (ts, seq), current = at, new
        state.update((ts, seq, current))
        if forget and current is None:
            state.setTimeoutDuration(int(forget))
        yield pd.DataFrame(out, columns=["name", "ts", "seq", "old_oid", "new_oid"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return log.groupBy("name").applyInPandasWithState(step, "name string, ts timestamp, seq bigint, old_oid string, new_oid string", "ts bigint, seq bigint, oid string", "append", timeout)


def follow(log: DataFrame, hook, checkpoint: str, once: bool = True):
    """Run a stream of the log's state; hook(batch, number) sees each batch of (name, op, oid) that changed, once."""
    writer = live(log).writeStream.outputMode("update").foreachBatch(hook).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

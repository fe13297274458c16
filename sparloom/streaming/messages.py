"""Message streams: latest-value store, joint trigger by a time matrix, stale-entry eviction; batch forms and streams.

The batch forms are window queries; the streams are Structured Streaming with event time, watermarks and state timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def repeat_runs(messages: DataFrame, name: str = "name", ts: str = "ts", payload: str = "payload") -> DataFrame:
    """Batch: each message with its repeat count: equal payloads in a row count up, a new payload starts at 1."""
    w = W.partitionBy(name).orderBy(ts, payload)
    new = (~F.lag(payload).over(w).eqNullSafe(F.col(payload))) | F.lag(F.lit(1)).over(w).isNull()
    run = F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    m = messages.withColumn("run", run)
    return m.withColumn("repeats", F.row_number().over(W.partitionBy(name, "run").orderBy(ts, payload))).drop("run")


def latest_values(messages: DataFrame, name: str = "name", ts: str = "ts", payload: str = "payload") -> DataFrame:
    """Batch: the last payload per name and its repeat count."""
    return repeat_runs(messages, name, ts, payload).groupBy(name).agg(F.max_by(F.struct(payload, "repeats"), F.struct(ts, payload)).alias("v"), F.max(ts).alias("last_ts")).select(name, f"v.{payload}", "v.repeats", "last_ts")


def fetchable(messages: DataFrame, count: int, **cols) -> DataFrame:
    """Batch: messages at which a payload has been repeated often enough, once per run."""
    return repeat_runs(messages, **cols).where(F.col("repeats") == count)


def joint_pairs(a: DataFrame, b: DataFrame, forward_ms: int, backward_ms: int, key: str = "key") -> DataFrame:
    """Batch or stream: pairs of two sources within the matrix entries: a at most forward_ms before b, b at most backward_ms before a.

    A sequence of time buckets makes the interval join an equi join, so it neither crosses nor broadcasts.
    """
    width = max(1, forward_ms, backward_ms)
    left = a.select(F.col(key), F.col("ts").alias("a_ts"), F.col("value").alias("a_value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("a_ms")).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("a_ms") - backward_ms) / width), F.floor((F.col("a_ms") + forward_ms) / width))))
    right = b.select(F.col(key), F.col("ts").alias("b_ts"), F.col("value").alias("b_value"), F.unix_millis(F.col("ts").cast("timestamp")).alias("b_ms")).withColumn("bucket", F.floor(F.col("b_ms") / width))
    near = (F.col("b_ms") - F.col("a_ms") <= forward_ms) & (F.col("a_ms") - F.col("b_ms") <= backward_ms)
    return left.join(right, [key, "bucket"]).where(near).select(key, "a_ts", "a_value", "b_ts", "b_value")


def joint_stream(a: DataFrame, b: DataFrame, forward_ms: int, backward_ms: int, key: str = "key") -> DataFrame:
    """Stream: the same by a watermarked stream-stream join; the delay is the largest matrix entry."""
    delay = f"{max(1, forward_ms, backward_ms)} milliseconds"
    left = a.select(F.col(key), F.col("ts").alias("a_ts"), F.col("value").alias("a_value")).withWatermark("a_ts", delay).alias("l")
    right = b.select(F.col(key).alias("b_key"), F.col("ts").alias("b_ts"), F.col("value").alias("b_value")).withWatermark("b_ts", delay).alias("r")
    cond = F.expr(f"{key} = b_key and b_ts <= a_ts + interval {forward_ms} milliseconds and b_ts >= a_ts - interval {backward_ms} milliseconds")
    return left.join(right, cond).select(key, "a_ts", "a_value", "b_ts", "b_value")


def unexpired(messages: DataFrame, now, window_ms: int, name: str = "name", ts: str = "ts") -> DataFrame:
    """Batch: names whose last arrival is not older than the receive window at ``now``."""
    return messages.groupBy(name).agg(F.max(ts).alias("last_ts")).where(F.unix_millis(now) - F.unix_millis(F.col("last_ts").cast("timestamp")) <= window_ms)


STORE = "name string, payload string, repeats bigint, last_ts timestamp"


def latest_stream(messages: DataFrame, window_ms: int | None = None) -> DataFrame:
    """Stream (name, ts, payload): the store's entry of each name after every batch; an entry older than the window is evicted by a timer."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        payload, repeats, last = state.get if state.exists else (None, 0, None)
        for pdf in batches:
            for ts, p in pdf.sort_values(["ts", "payload"])[["ts", "payload"]].itertuples(index=False):
                repeats = repeats + 1 if repeats and p == payload else 1
                payload, last = p, ts if last is None else max(ts, pd.Timestamp(last))
        state.update((payload, repeats, last))
        if window_ms is not None:
            state.setTimeoutTimestamp(int(pd.Timestamp(last).timestamp() * 1000) + window_ms)
        yield pd.DataFrame([(key[0], payload, repeats, last)], columns=["name", "payload", "repeats", "last_ts"])

    src = messages.withWatermark("ts", f"{window_ms} milliseconds") if window_ms is not None else messages
    timeout = GroupStateTimeout.EventTimeTimeout if window_ms is not None else GroupStateTimeout.NoTimeout
    return src.groupBy("name").applyInPandasWithState(step, STORE, "payload string, repeats bigint, last_ts timestamp", "update", timeout)


def training_log(lines: DataFrame) -> DataFrame:
    """Log lines (id, line) as step, loss, lr and accuracy; lines without a step are dropped."""
    x = lambda p: F.expr(f"try_cast(regexp_extract(line, \"{p}\", 1) as double)")
    return lines.select("id", x("step[=: ]+([0-9]+)").cast("bigint").alias("step"), x("loss[=: ]+([0-9.]+)").alias("loss"), x("lr[=: ]+([0-9.e-]+)").alias("lr"), x("acc[=: ]+([0-9.]+)").alias("acc")).where("step is not null")


def replay(events: DataFrame, last_id: int, cap: int = 2000) -> DataFrame:
    """Events after an id, the newest ``cap`` of them (the replay buffer is bounded by design)."""
    return events.where(F.col("id") > last_id).orderBy(F.desc("id")).limit(cap)

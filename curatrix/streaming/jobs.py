"""Keyed, time-based rules as Structured Streaming jobs.

Sources and sinks are given by the caller; batch sizes are bounded with the source's
maxFilesPerTrigger or maxBytesPerTrigger. State lives in the checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import buckets

BREAKER_OUT = "domain string, opened_at timestamp, until timestamp, failures int"
COOLDOWN_OUT = "scope string, blocked_at timestamp, strikes int, cooldown_sec long, until timestamp"


def _ordered(frames: Iterator[pd.DataFrame]) -> list[tuple]:
    rows = [r for f in frames for r in f.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


def domain_breaker(stream: DataFrame, threshold: int = 3, window_sec: int = 600, cooldown_sec: int = 600) -> DataFrame:
    """Open a domain's breaker after ``threshold`` failures in the window; a success clears the count.

    ``stream``: domain, ts (timestamp), ok. A domain keeps its failure times of one window
    and its newest event time; it is forgotten when the watermark has passed that time by
    a window and a cooldown, so silence in some micro-batches loses nothing.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent, until, newest = state.get if state.exists else ([], 0, 0)
        recent, out = list(recent), []
        for _, ts, ok in _ordered(frames):
            now = ts.value // 1000
            newest = max(newest, now)
            if until and now >= until:
                recent, until = [], 0
            if ok:
                recent = []
                continue
            recent = [t for t in recent if t >= now - window_sec * 1_000_000] + [now]
            if len(recent) >= threshold and now + cooldown_sec * 1_000_000 > until:
                until = now + cooldown_sec * 1_000_000
                out.append((key[0], ts, pd.Timestamp(until, unit="us"), len(recent)))
        state.update((recent, until, newest))
        _forget_after(state, newest, window_sec + cooldown_sec)
        yield pd.DataFrame(out, columns=["domain", "opened_at", "until", "failures"])

    rows = stream.select("domain", "ts", "ok").withWatermark("ts", f"{window_sec} seconds")
    return rows.groupBy("domain").applyInPandasWithState(
        step, BREAKER_OUT, "recent array<long>, until long, newest long", "append", GroupStateTimeout.EventTimeTimeout)


def adaptive_cooldown(stream: DataFrame, failures: int = 2, base_sec: int = 300, max_sec: int = 21600, ttl_days: int = 45) -> DataFrame:
    """Cooldown of a scope doubles with every strike up to a cap; a success resets the failure count.

    ``stream``: scope, ts (timestamp), ok. A scope that is silent for ``ttl_days`` of event
    time is forgotten.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, strikes, until, newest = state.get if state.exists else (0, 0, 0, 0)
        out = []
        for _, ts, ok in _ordered(frames):
            now = ts.value // 1000
            newest = max(newest, now)
            if until and now >= until:
                count, until = 0, 0
            if ok:
                count, until = 0, 0
                continue
            count += 1
            if count < failures:
                continue
            strikes += 1
            wait = min(max_sec, base_sec * 2 ** (strikes - 1))
            until, count = now + wait * 1_000_000, 0
            out.append((key[0], ts, strikes, wait, pd.Timestamp(until, unit="us")))
        state.update((count, strikes, until, newest))
        _forget_after(state, newest, ttl_days * 86400)
        yield pd.DataFrame(out, columns=["scope", "blocked_at", "strikes", "cooldown_sec", "until"])

    rows = stream.select("scope", "ts", "ok").withWatermark("ts", "10 minutes")
    return rows.groupBy("scope").applyInPandasWithState(
        step, COOLDOWN_OUT, "count int, strikes int, until long, newest long", "append", GroupStateTimeout.EventTimeTimeout)


def _forget_after(state: GroupState, newest: int, seconds: int) -> None:
    """Timeout counted from the key's own newest event (microseconds), not from the watermark alone."""
    mark = max(state.getCurrentWatermarkMs(), newest // 1000)
    state.setTimeoutTimestamp(mark + seconds * 1000 + 1)


def first_seen(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Pass each key once; a key may pass again after ``within`` of event time."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def step_counts(stream: DataFrame, ts: str, step: str, width: str = "15 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per step in tumbling (or sliding) windows; rows later than the watermark are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), step).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), step, "n")


def session_counts(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per session of a key; a session ends after ``gap`` without events."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def address_path(target: str) -> str:
    return f"{target.rstrip('/')}-addresses"


def stream_write(stream: DataFrame, write: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], target: str, checkpoint: str, addresses: DataFrame, keys: list[str], trigger: dict[str, Any] | None = None):
    """Run the write path per micro-batch.

    ``write(batch, known)`` gives (accepted rows, new addresses); ``known`` holds the given
    addresses and those that earlier batches added, so their ids go on. A batch owns its
    partition of the added addresses, so a replayed batch replaces itself. Accepted rows are
    merged by ``keys`` into a bucketed table, where a batch counts once and rewrites only
    the buckets of its keys; ``current_rows`` reads it.
    """
    spark, added = addresses.sparkSession, address_path(target)
    addresses.limit(0).write.mode("overwrite").parquet(f"{added}/batch_id=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        earlier = spark.read.parquet(added).filter(F.col("batch_id") < batch_id).drop("batch_id")
        accepted, fresh = write(batch, addresses.unionByName(earlier, allowMissingColumns=True))
        fresh.write.mode("overwrite").parquet(f"{added}/batch_id={batch_id}")
        if buckets.state_of(spark, target) is None:
            buckets.create(accepted, target, keys, batch_id=batch_id)
        else:
            buckets.merge(accepted, target, batch_id=batch_id)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_rows(spark: SparkSession, target: str) -> DataFrame:
    """Newest written row of each key."""
    return buckets.read(spark, target)


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available and stop; rows go to a parquet table."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_result(spark: SparkSession, target: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(target)


def to_instant(ts: Column) -> Column:
    """Zone-free stamp as an instant, for event-time columns."""
    return ts.cast("timestamp")

"""Structured Streaming jobs: windowed usage, roll-ups, sessions, and keyed state for buckets, caches and alerts.

Event time and watermarks are explicit; each job has a batch twin among the queries, and tests replay files through both.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.sources.versioned import VersionedTable


def events(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of event files; ts becomes a timestamp, which a watermark needs."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def usage_per_minute(stream: DataFrame, late: str = "60 minutes") -> DataFrame:
    w = F.window("ts", "1 minute").alias("w")
    return stream.withWatermark("ts", late).groupBy("user_id", w).agg(F.count("*").alias("requests"), F.sum(F.length("props")).alias("tokens"))


def rollup(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("event_type", F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(stream: DataFrame, idle: str = "24 hours", late: str = "24 hours") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("n"))


def token_totals(stream: DataFrame) -> DataFrame:
    return stream.groupBy("user_id").agg(F.count("*").alias("tokens"), F.sum(F.length("props")).alias("chars"))


def _ordered(frames: Iterator[pd.DataFrame]):
    rows = pd.concat(list(frames))
    return rows.sort_values(["ts", "event_id"]).itertuples()


def token_bucket(stream: DataFrame, per_minute: int = 30) -> DataFrame:
    """event_id, admitted, wait: a bucket of 2 x per_minute tokens for each user, refilled by the second."""
    rate, burst = per_minute / 60, 2.0 * per_minute

    def admit(key, frames, state: GroupState):
        tokens, last = state.get if state.exists else (burst, None)
        out = []
        for r in _ordered(frames):
            now = r.ts.timestamp()
            tokens = min(burst, tokens + (0 if last is None else max(0.0, now - last)) * rate)
            last = now if last is None else max(last, now)
            if tokens >= 1:
                tokens -= 1
                out.append((key[0], r.event_id, True, 0.0))
            else:
                out.append((key[0], r.event_id, False, (1 - tokens) / rate))
                tokens = 0.0
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "admitted", "wait"])

    return stream.groupBy("user_id").applyInPandasWithState(admit, "user_id long, event_id long, admitted boolean, wait double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def cache_labels(stream: DataFrame, ttl: float) -> DataFrame:
    """event_id, hit: an entry lives ttl seconds from its creation."""

    def label(key, frames, state: GroupState):
        made = state.get[0] if state.exists else None
        out = []
        for r in _ordered(frames):
            now = r.ts.timestamp()
            hit = made is not None and now - made < ttl
            made = made if hit else now
            out.append((*key, r.event_id, hit))
        state.update((made,))
        yield pd.DataFrame(out, columns=["user_id", "event_type", "event_id", "hit"])

    return stream.groupBy("user_id", "event_type").applyInPandasWithState(label, "user_id long, event_type string, event_id long, hit boolean", "made double", "append", GroupStateTimeout.NoTimeout)


def alerts(stream: DataFrame, cooldown: float) -> DataFrame:
    """user_id, event_id: at most one alert of a user within the cooldown."""

    def fire(key, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for r in _ordered(frames):
            now = r.ts.timestamp()
            if last is None or now - last > cooldown:
                last = now
                out.append((key[0], r.event_id))
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id"])

    return stream.groupBy("user_id").applyInPandasWithState(fire, "user_id long, event_id long", "last double", "append", GroupStateTimeout.NoTimeout)


def flush_by_time(stream: DataFrame, seconds: float) -> DataFrame:
    """user_id, event_id, flush: a new flush group once `seconds` have passed since the last flush."""

    def group(key, frames, state: GroupState):
        number, last = state.get if state.exists else (0, None)
        out = []
        for r in _ordered(frames):
            now = r.ts.timestamp()
            if last is None:
                last = now
            elif now - last >= seconds:
                number, last = number + 1, now
            out.append((key[0], r.event_id, number))
        state.update((number, last))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "flush"])

    return stream.groupBy("user_id").applyInPandasWithState(group, "user_id long, event_id long, flush long", "number long, last double", "append", GroupStateTimeout.NoTimeout)


def incremental_index(stream: DataFrame, table: VersionedTable, checkpoint: str):
    """New files are merged into the table, batch by batch: every batch rewrites the buckets it touches. A batch that is run again, or begun
    and not ended, changes nothing twice: its number stands in the version that holds it."""
    return stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

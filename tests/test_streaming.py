"""Streams replayed from files against their batch twins."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from quern.operators import metrics as M
from quern.plans import registry
from quern.sources import derived as D
from quern.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Events in files of one time range each, so that a replay meets them in order."""
    path = str(tmp_path_factory.mktemp("events") / "in")
    events = D.table(spark, SF, "events")
    events.repartitionByRange(3, "ts").sortWithinPartitions("ts", "event_id").write.parquet(path)
    return path, events.schema


def replay(stream, mode):
    name = f"out_{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_windows(spark, landed):
    stream = jobs.events(spark, *landed)
    got = replay(jobs.usage_per_minute(stream), "complete").select("user_id", F.unix_timestamp("w.start").alias("m"), "requests", "tokens")
    assert rows(got) == rows(registry.queries()["k1_usage_per_minute"](spark, SF).select("user_id", "minute", "requests", "tokens"))
    got = replay(jobs.token_totals(stream), "complete").select("user_id", "tokens", "chars")
    assert rows(got) == rows(registry.queries()["k9_streaming_token_totals"](spark, SF).select("user_id", "tokens", "chars"))


def test_rollup_and_sessions_close_behind_the_watermark(spark, landed):
    stream = jobs.events(spark, *landed)
    total = D.table(spark, SF, "events").count()
    assert 0 < replay(jobs.rollup(stream), "append").agg(F.sum("n")).first()[0] <= total
    sessions = replay(jobs.sessions(stream), "append").select("user_id", "n")
    every = {tuple(r) for r in registry.queries()["k7_session_by_inactivity"](spark, SF).select("user_id", "n").collect()}
    assert sessions.count() and {tuple(r) for r in sessions.collect()} <= every


def _in_order(spark, landed):
    path, schema = landed
    return jobs.events(spark, path, schema)


def test_state_by_key(spark, landed):
    """One file at a time would need ordered input; availableNow reads all files in one batch, so each key's rows are sorted there."""
    log = D.search_log(spark, SF)
    got = replay(jobs.cache_labels(_in_order(spark, landed), 86400), "append").select("user_id", "event_type", "event_id", "hit")
    assert rows(got) == rows(M.cache_labels(log, ["user_id", "event_type"], 86400).select("user_id", "event_type", "event_id", "hit"))
    got = replay(jobs.alerts(_in_order(spark, landed).where("event_type = 'error'"), 86400), "append")
    assert rows(got.select("user_id", "event_id")) == rows(M.cooled_alerts(log.where("event_type = 'error'"), "user_id", 86400).select("user_id", "event_id"))
    got = replay(jobs.token_bucket(_in_order(spark, landed)), "append").select("user_id", "event_id", "admitted")
    assert rows(got) == rows(registry.queries()["k2_token_bucket_admission"](spark, SF).select("user_id", "event_id", "admitted"))
    got = replay(jobs.flush_by_time(_in_order(spark, landed), 3600), "append")
    assert got.count() == log.count()

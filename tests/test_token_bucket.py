"""The token bucket over ranges against one bucket after the other."""

import random
from fractions import Fraction

import pytest

from quern.operators import metrics as M


def brute(rows, rate, burst):
    out, buckets = {}, {}
    for key, t, event in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        tokens, last = buckets.get(key, (Fraction(burst), t))
        tokens = min(Fraction(burst), tokens + Fraction(t - last, 1_000_000) * Fraction(rate))
        ok = tokens >= 1
        out[event] = (key, ok, 0.0 if ok else float((1 - tokens) / Fraction(rate)))
        buckets[key] = (tokens - 1 if ok else Fraction(0), t)
    return out


@pytest.mark.parametrize("rate, burst", [(0.5, 60.0), (2.0, 3.0), (0.1, 1.5)])
def test_one_key_with_most_rows(spark, rate, burst):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.9 else rng.choice([None, 1, 2, 9]), int(rng.expovariate(1) * 1e6) + k * rng.choice([1, 300_000]), k) for k in range(6000)]
    rows += [(7, rows[0][1], 9000), (7, rows[0][1], 9001)]  # equal times
    df = spark.createDataFrame(rows, "u long, micros long, event_id long").selectExpr("u", "timestamp_micros(micros) AS ts", "event_id")
    out = M.token_bucket(df, "u", rate, burst)
    got = {r["event_id"]: (r["u"], r["admitted"], r["wait"]) for r in out.collect()}
    expected = brute(rows, Fraction(rate).limit_denominator(1_000_000), burst)
    assert set(got) == set(expected)
    for event, (key, ok, wait) in expected.items():
        assert got[event][:2] == (key, ok) and got[event][2] == pytest.approx(wait)
    assert {True, False} == {ok for _, ok, _ in expected.values()}


def test_a_key_spans_ranges(spark):
    df = spark.range(4000).selectExpr("1L AS u", "timestamp_micros(id * 100000) AS ts", "id AS event_id")
    order = ["u", "t", "event_id"]
    dealt = M.ranges(df.selectExpr("u", "unix_micros(ts) AS t", "event_id"), order, "t")
    sizes = [r["count"] for r in dealt.groupBy("part").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2000


def test_maps_compose():
    rng = random.Random(2)
    for _ in range(2000):
        maps = [(rng.randint(-9, 9), *sorted((rng.randint(-5, 9), rng.randint(-5, 9)))) for _ in range(rng.randint(1, 5))]
        whole = maps[0]
        for m in maps[1:]:
            whole = M.clamped(whole, m)
        x = y = rng.randint(-20, 20)
        for a, low, high in maps:
            y = min(high, max(low, y + a))
        assert y == min(whole[2], max(whole[1], x + whole[0]))


def test_empty(spark):
    df = spark.createDataFrame([], "u long, ts timestamp, event_id long")
    assert M.token_bucket(df, "u", 0.5, 60.0).count() == 0


def test_running_counts_and_alerts(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), rng.randrange(0, 40_000_000) * 1000, k, rng.choice([100.0, 3999.0, 4000.5, 9000.0]), rng.random() > 0.15) for k in range(1500)]
    rows += [(1, rows[0][1], 5000 + k, 9000.0, False) for k in range(3)]  # equal times
    df = spark.createDataFrame(rows, "u long, micros long, event_id long, latency_ms double, success boolean").selectExpr("u", "timestamp_micros(micros) AS ts", "event_id", "latency_ms", "success")
    expected, points = {}, []
    for key in (1, 2, None):
        bad = 0
        for n, (_, t, event, latency, success) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            bad += not success
            expected[event] = (bad, n)
            points += [(key, "high_latency", t, event)] if latency > 4000 else []
            points += [(key, "high_error_rate", t, event)] if not success and bad > n * 0.1 else []
    got = M.running(df, "u", {"bad": ~df.success, "seen": df.event_id.isNotNull()})
    assert {r["event_id"]: (r["bad"], r["seen"]) for r in got.collect()} == expected
    last, fired = {}, set()
    for key, alert, t, event in sorted(points, key=lambda p: (p[2], p[3])):
        if (key, alert) not in last or t - last[key, alert] > 900_000_000:
            last[key, alert] = t
            fired.add((key, alert, event))
    assert {(r["u"], r["alert"], r["event_id"]) for r in M.cooled_alerts(M.alert_points(df, "u"), ["u", "alert"], 900).collect()} == fired

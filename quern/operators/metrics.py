"""Latency, usage and quality metrics over logs of searches, and windows over conversations."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quern.operators.wordindex import small
from quern.sources.scratch import materialize

# ---- Fixed values: thresholds, prices for a million tokens, weights and words of the response score -------------------
LATENCY_MS, ERROR_RATE, HIT_RATE = 2000.0, 0.05, 0.6
PRICES = {"large": (5.32, 16.00), "medium": (0.59, 0.79), "mixed": (0.24, 0.24), "small": (0.05, 0.08)}
RESPONSE_WEIGHTS = {"relevance": 0.25, "accuracy": 0.25, "completeness": 0.20, "clarity": 0.15, "tone": 0.10, "sources": 0.05}
COMMON_WORDS = ["the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "of"]
POLITE = ["please", "thank you", "would", "could", "recommend", "suggest", "consider", "additionally", "furthermore"]
CASUAL = ["hey", "yeah", "nope", "gonna", "wanna", "lol", "btw"]


def share(c: Column) -> Column:
    return F.coalesce(F.round(F.avg(c.cast("int")), 6), F.lit(0.0))


#: Cells that a range of values is cut into, and distinct values that are put in order in one task.
CELLS, FEW = 1024, 20_000


def order_statistics(df: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """group and, for each name, the value at a rank (from 1, an expression over n), exactly. Equal values are counted first. As long as more
    than FEW distinct values may hold a rank, their range is cut into cells, cells are counted for all groups at once, and the range becomes
    that of the cell with the rank; only what is left is ordered. Nulls and NaN are left out."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    counts = materialize(rows.groupBy("g", "v").agg(F.count("*").alias("k")), "counts")
    whole = counts.groupBy("g").agg(F.sum("k").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size"))
    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()])).alias("r")
    found = materialize(whole.select("g", named, "low", "high", "size", F.lit(0).cast("long").alias("below")).select("g", "r.name", "r.rank", "low", "high", "size", "below"), "ranges")
    same = counts["g"].eqNullSafe(F.col("t.g"))
    # Evenly by logarithm, which keeps the order, and by value where logarithms no longer differ.
    flat = lambda c: F.signum(c) * F.log1p(F.abs(c))
    even = lambda x, low, high: (x - low) / (high - low)
    while not (wide := found.where((F.col("size") > FEW) & (F.col("low") < F.col("high")))).isEmpty():
        inside = counts.join(small(wide.alias("t")), same & counts["v"].between(F.col("t.low"), F.col("t.high")))
        place = F.when(flat(F.col("high")) > flat(F.col("low")), even(flat(F.col("v")), flat(F.col("low")), flat(F.col("high")))).otherwise(even(F.col("v"), F.col("low"), F.col("high")))
        cells = inside.groupBy("t.g", "name", "rank", "below", F.least(F.floor(place * CELLS), F.lit(CELLS - 1)).alias("cell")).agg(F.sum("k").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size"))
        upto = F.col("below") + F.sum("k").over(W.partitionBy("g", "name").orderBy("cell"))
        reached = cells.withColumn("upto", upto).where("upto >= rank").groupBy("g", "name").agg(F.min_by(F.struct("rank", "low", "high", "size", (F.col("upto") - F.col("k")).alias("below")), "cell").alias("c"))
        done = found.where((F.col("size") <= FEW) | (F.col("low") >= F.col("high")))
        found = materialize(done.union(reached.select("g", "name", "c.*")), "ranges")
    last = counts.join(small(found.alias("t")), same & counts["v"].between(F.col("t.low"), F.col("t.high")))
    upto = F.col("below") + F.sum("k").over(W.partitionBy("t.g", "name").orderBy("v"))
    got = last.select("t.g", "name", "rank", "v", upto.alias("upto")).where("upto >= rank")
    return got.groupBy(F.col("g").alias(group)).agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in ranks])


def nearest_rank(p: float) -> Column:
    """sorted[int(n p)], from 1."""
    return F.least(F.col("n"), F.floor(F.col("n") * p) + 1)


def summary(df: DataFrame, group: str, value: str, slow: float) -> DataFrame:
    """Count, mean, least, most, median, sample deviation, p95 and p99 by nearest rank, share over `slow`."""
    base = df.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.min(value), 4).alias("least"), F.round(F.max(value), 4).alias("most"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("std"), share(F.col(value) > slow).alias("slow"))
    ranks = order_statistics(df, group, value, {"p95": nearest_rank(0.95), "p99": nearest_rank(0.99), "__a": F.floor((F.col("n") + 1) / 2), "__b": F.floor(F.col("n") / 2) + 1})
    return base.join(ranks, group).select(*base.columns, F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"), F.round((F.col("__a") + F.col("__b")) / 2, 4).alias("median"))


def exclusive_quantile(df: DataFrame, group: str, value: str, parts: dict[str, float]) -> DataFrame:
    """Quantiles at place p (n + 1), between neighbours."""
    at = lambda p: F.col("n") * 1.0 * p + p
    ranks = {}
    for name, p in parts.items():
        ranks[f"__{name}a"] = F.greatest(F.lit(1), F.least(F.floor(at(p)), F.col("n")))
        ranks[f"__{name}b"] = F.greatest(F.lit(1), F.least(F.floor(at(p)) + 1, F.col("n")))
    got = order_statistics(df, group, value, ranks).join(df.groupBy(group).agg(F.count("*").alias("n")), group)
    return got.select(group, *[F.round(F.col(f"__{k}a") + (F.col(f"__{k}b") - F.col(f"__{k}a")) * (at(p) - F.floor(at(p))), 4).alias(k) for k, p in parts.items()])


def totals(log: DataFrame) -> DataFrame:
    """One row: counts, rates and means of a search log."""
    n = F.count("*")
    return log.agg(n.alias("n"), F.count_if("success").alias("succeeded"), share(F.col("success")).alias("success_rate"), share(~F.col("success")).alias("error_rate"), F.coalesce(F.round(F.avg(F.when(F.col("success"), F.col("results"))), 6), F.lit(0.0)).alias("mean_results"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"))


def health(log: DataFrame) -> DataFrame:
    """good, degraded or poor, by p95 latency and error rate."""
    p95 = order_statistics(log.withColumn("__g", F.lit(1)), "__g", "latency_ms", {"p95": nearest_rank(0.95)})
    rates = log.agg(share(~F.col("success")).alias("error_rate")).withColumn("__g", F.lit(1))
    state = F.when(F.col("error_rate") > ERROR_RATE, "poor").when(F.col("p95") > LATENCY_MS, "degraded").otherwise("good")
    return p95.join(rates, "__g").select(F.round("p95", 4).alias("p95"), "error_rate", state.alias("health"))


def trends(df: DataFrame, value: str, ts: str, start: str, end: str, step: str) -> DataFrame:
    """Fixed half-open periods from start to end, zeros where nothing happened."""
    spine = df.sparkSession.range(1).select(F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}' - interval {step}, interval {step})")).alias("period"))
    rows = df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    got = rows.groupBy(F.window(ts, step).alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    got = got.select(F.col("w.start").alias("period"), "n", "mean", "most")
    zero = lambda c: F.coalesce(F.round(c, 4), F.lit(0.0)).alias(c)
    return spine.join(got, "period", "left").select("period", F.coalesce("n", F.lit(0)).cast("long").alias("n"), zero("mean"), zero("most"))


def recent(df: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The last k rows of each group."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(order)))).where(F.col("__r") <= k).drop("__r")


def fit_window(messages: DataFrame, tokens: Column, budget: int, extra: int = 4) -> DataFrame:
    """System messages, and of the others the newest whose tokens still fit; the first that does not fit ends it."""
    rows = messages.withColumn("__t", tokens + extra).withColumn("__s", F.sum(F.when(F.col("role") == "system", F.col("__t")).otherwise(0)).over(W.partitionBy("conv_id")))
    back = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    used = F.sum(F.when(F.col("role") != "system", F.col("__t")).otherwise(0)).over(back)
    return rows.withColumn("__u", used).where((F.col("role") == "system") | (F.col("__u") + F.col("__s") <= budget)).drop("__t", "__s", "__u")


def pair_turns(messages: DataFrame) -> DataFrame:
    """Each user message with the reply that follows it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = messages.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("__r"), F.lead("text").over(w).alias("reply"))
    return rows.where((F.col("role") == "user") & (F.col("__r") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "reply", F.sha2(F.concat_ws(":", "conv_id", "turn"), 256).alias("turn_id"))


def message_groups(messages: DataFrame, most: int = 500) -> DataFrame:
    """Neighbouring messages of one role, both under `most` characters, form a group."""
    w = W.partitionBy("conv_id").orderBy("turn")
    same = (F.lag("role").over(w) == F.col("role")) & (F.length("text") < most) & (F.length(F.lag("text").over(w)) < most)
    rows = messages.withColumn("grp", F.sum(F.when(same, 0).otherwise(1)).over(w))
    return rows.groupBy("conv_id", "grp").agg(F.min("turn").alias("first"), F.count("*").alias("n"), F.first("role").alias("role"))


def response_scores(pairs: DataFrame, expected: str | None = None) -> DataFrame:
    """Six scores of each question and reply, and their weighted sum. expected: a column with the strings that a right reply holds, an
    array; accuracy is the share of them that it does hold, and 0.8 where none are stated."""
    asked = F.col(expected) if expected else F.expr("cast(null as array<string>)")
    found = F.size(F.filter(asked, lambda x: F.contains(F.lower("reply"), F.lower(x))))
    words = lambda c: F.array_except(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > 0)), F.array(*map(F.lit, COMMON_WORDS)))
    a, b = words("question"), words("reply")
    nq, nr = (F.size(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)) for c in ("question", "reply"))
    hits = lambda group: sum((F.contains(F.lower("reply"), F.lit(w)).cast("int") for w in group), F.lit(0))
    n_sentences = F.size(F.split("reply", r"\."))
    mean = nr / n_sentences
    scores = {
        "relevance": F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(a, b)) / F.size(a) + 0.3)),
        "accuracy": F.when(F.coalesce(F.size(asked), F.lit(0)) > 0, found / F.greatest(F.size(asked), F.lit(1))).otherwise(0.8),
        "completeness": F.when(nr < nq * 2, 0.3).when(nr < nq * 5, 0.6).otherwise(F.least(F.lit(1.0), 0.8 + nr / (nq * 10) * 0.2)),
        "clarity": F.least(F.lit(1.0), 0.5 + F.when(n_sentences > 1, 0.2).otherwise(0.0) + F.when(F.col("reply").rlike(r"[•*-]|1\.|2\."), 0.2).otherwise(0.0) + F.when(mean.between(10, 25), 0.1).otherwise(0.0)),
        "tone": F.when(hits(CASUAL) > 0, F.greatest(F.lit(0.3), 0.7 - hits(CASUAL) * 0.1)).otherwise(F.least(F.lit(1.0), 0.7 + hits(POLITE) * 0.05)),
        "sources": F.when(F.contains(F.lower("reply"), F.lit("according to")) | F.contains(F.lower("reply"), F.lit("source:")), 1.0).otherwise(0.8),
    }
    out = pairs.withColumns({k: F.round(c, 6) for k, c in scores.items()})
    return out.withColumn("overall", F.round(sum((F.col(k) * w for k, w in RESPONSE_WEIGHTS.items()), F.lit(0.0)), 8))


def folded(df: DataFrame, keys: list[str], values: list[Column], step: Callable, schema: str) -> DataFrame:
    """keys and what step gives for each row: step(state, *values) returns the state after the row and a tuple of results, or None for no
    row; state is None at a key's first row. Rows are dealt by key, sorted by it and by all values, and pass through one after another:
    whatever a key's rows, a task holds one batch and one state. Only a key's own rows are sequential, as the rule demands."""
    names = [f"v{i}" for i in range(len(values))]
    base = df.select(*keys, *(v.alias(n) for v, n in zip(values, names)))
    out = StructType([*base.schema.fields[: len(keys)], *StructType.fromDDL(schema).fields])
    types = [to_arrow_type(f.dataType) for f in out.fields]

    def run(batches):
        now, state = object(), None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = []
            for key, row in zip(zip(*columns[: len(keys)]), zip(*columns[len(keys) :])):
                if key != now:
                    now, state = key, None
                state, result = step(state, *row)
                if result is not None:
                    rows.append((*key, *result))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], out.names)

    return base.repartition(*keys).sortWithinPartitions(*keys, *names).mapInArrow(run, out)


def cache_labels(requests: DataFrame, keys: list[str], ttl: int, ts: str = "ts") -> DataFrame:
    """hit or miss of each request: an entry lives ttl seconds from its creation, and a hit does not renew it. Batch twin of the stateful
    stream."""

    def step(made, t, event_id):
        hit = made is not None and t - made < ttl * 1_000_000
        return (made if hit else t), (event_id, hit)

    return folded(requests, keys, [F.unix_micros(ts), F.col("event_id")], step, "event_id long, hit boolean")


def running(log: DataFrame, key: str, counts: dict[str, Column], ts: str = "ts", unit: str = "hour") -> DataFrame:
    """log with running counts of conditions for each key, by time and event_id, the row itself included: counts within a unit of time, and those of
    the units before, so that what one task orders is a unit of one key."""
    rows = log.select("*", F.date_trunc(unit, ts).alias("__unit"), *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"__{n}") for n, c in counts.items()])
    units = rows.groupBy(F.col(key).alias("__key"), F.col("__unit").alias("__of")).agg(*[F.sum(f"__{n}").alias(f"__u{n}") for n in counts])
    ahead = W.partitionBy("__key").orderBy("__of").rowsBetween(W.unboundedPreceding, -1)
    units = units.select("__key", "__of", *[F.coalesce(F.sum(f"__u{n}").over(ahead), F.lit(0)).alias(f"__b{n}") for n in counts])
    within = W.partitionBy(key, "__unit").orderBy(ts, "event_id").rowsBetween(W.unboundedPreceding, 0)
    full = rows.withColumns({f"__w{n}": F.sum(f"__{n}").over(within) for n in counts})
    full = full.join(units, full[key].eqNullSafe(units["__key"]) & full["__unit"].eqNullSafe(units["__of"]))
    return full.select(*log.columns, *[(F.col(f"__w{n}") + F.col(f"__b{n}")).alias(n) for n in counts])


def alert_points(log: DataFrame, key: str) -> DataFrame:
    """key, alert, ts, event_id of what may raise an alert: a latency over twice the threshold, and a failure while the key's error rate so far is over
    twice its threshold."""
    seen = running(log, key, {"bad": ~F.col("success"), "seen": F.lit(1)})
    slow = F.when(F.col("latency_ms") > 2 * LATENCY_MS, "high_latency")
    failing = F.when(~F.col("success") & (F.col("bad") > F.col("seen") * (2 * ERROR_RATE)), "high_error_rate")
    return seen.select(key, "ts", "event_id", F.explode(F.array_compact(F.array(slow, failing))).alias("alert"))


def cooled_alerts(points: DataFrame, key: str | list[str], seconds: int, ts: str = "ts") -> DataFrame:
    """At most one alert of a key within `seconds`."""

    def step(last, t, event_id):
        fires = last is None or t - last > seconds * 1_000_000
        return (t, (event_id,)) if fires else (last, None)

    return folded(points, [key] if isinstance(key, str) else key, [F.unix_micros(ts), F.col("event_id")], step, "event_id long")


def ranges(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """rows dealt out in one order over all of them, with `part`, the number of the range that a row lies in: written, so that every later pass
    meets the same ranges. A key with any share of the rows lies in as many ranges as it takes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    return materialize(dealt, tag)


def in_order(dealt: DataFrame, order: list[str]) -> DataFrame:
    """Every range in one task, in order."""
    return dealt.repartition("part").sortWithinPartitions("part", *order)


def clamped(first: tuple[int, int, int], then: tuple[int, int, int]) -> tuple[int, int, int]:
    """One after the other, of the maps (a, low, high): x to x + a, but low at least and high at most. It is such a map again."""
    (a, low, high), (b, least, most) = first, then
    return a + b, min(most, max(least, low + b)), min(most, max(least, high + b))


def token_bucket(requests: DataFrame, key: str, rate: float, burst: float, ts: str = "ts") -> DataFrame:
    """admitted and wait of each request: a bucket of `burst` tokens fills at `rate` a second, a request takes one; a request that is refused
    leaves the bucket empty. By key, time and event_id.

    What a request does to a bucket is an addition between two bounds, and so is what a run of requests does. Requests are therefore dealt
    into ranges of one order over all keys; a first pass reduces the runs at both ends of each range to such maps, the driver applies these
    (two for each range) one after the other, and a second pass begins every range with the state it then knows. Tokens are counted
    in whole units, so the result does not depend on the ranges, and one key's requests are not one task's."""
    exact = Fraction(rate).limit_denominator(1_000_000)
    unit, fill = exact.denominator * 1_000_000, exact.numerator  # units of a token, and units that a microsecond brings
    full = int(burst * unit)
    take = lambda dt: (dt * fill - unit, 0, full - unit)
    order = [key, "t", "event_id"]
    dealt = ranges(requests.select(key, F.unix_micros(ts).alias("t"), "event_id"), order, "requests")

    def runs(batches):
        """(part, key, t): rows in order."""
        for batch in batches:
            yield batch, zip(batch.column("part").to_pylist(), batch.column(key).to_pylist(), batch.column("t").to_pylist())

    def reduce(batches):
        found: list = []  # the runs of the range in hand: (part, key, first time, last time, map)

        def ends():
            out = found[:1] + (found[-1:] if len(found) > 1 else [])
            return [(p, pickle.dumps((k, a, b, m, n == 0, n == len(out) - 1))) for n, (p, k, a, b, m) in enumerate(out)]

        rows: list = []
        for _, part_rows in runs(batches):
            for part, k, t in part_rows:
                if found and found[-1][0] != part:
                    rows += ends()
                    found = []
                if found and found[-1][1] == k:
                    _, _, first, last, m = found[-1]
                    found[-1] = part, k, first, t, clamped(m, take(t - last))
                else:
                    del found[1:]  # only the first and the last run of a range reach into others
                    found.append((part, k, t, t, take(0)))
        rows += ends()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "run"])

    states: dict[int, tuple] = {}
    carried = None  # (key, units, time of the last request) at the end of the range before
    rows = sorted(in_order(dealt, order).select("part", key, "t").mapInArrow(reduce, "part int, run binary").collect(), key=lambda r: (r[0], not pickle.loads(r[1])[4]))
    for part, packed in rows:
        k, first, last, (a, low, high), begins, closes = pickle.loads(packed)
        known = begins and carried is not None and carried[0] == k
        units, before = carried[1:] if known else (full, first)
        if known:
            states[part] = units, before
        if closes:
            carried = k, min(high, max(low, units + (first - before) * fill + a)), last

    def admit(batches):
        held, now, state = None, object(), None
        for batch, part_rows in runs(batches):
            ok, wait = [], []
            for part, k, t in part_rows:
                if part != held:
                    held, now, state = part, k, states.get(part)
                elif k != now:
                    now, state = k, None
                units, last = state or (full, t)
                units = min(full, units + (t - last) * fill)
                ok.append(units >= unit)
                wait.append(0.0 if ok[-1] else (unit - units) / (fill * 1_000_000))
                state = max(units - unit, 0), t
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("event_id"), pa.array(ok, pa.bool_()), pa.array(wait, pa.float64())], [key, "event_id", "admitted", "wait"])

    kind = dealt.schema[key].dataType.simpleString()
    return in_order(dealt, order).select("part", key, "t", "event_id").mapInArrow(admit, f"`{key}` {kind}, event_id long, admitted boolean, wait double")

"""Queries over logs and conversations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import metrics as M
from quern.sources import derived as D

from .text_queries import _list

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


LOG = D.SEARCH_LOG_SQL
MSG = "conversations"
_TOK = "greatest(1, length(text) // 4)"


def _summary_sql(source: str, group: str, value: str, slow: str) -> str:
    return f"""sr AS (SELECT {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {group} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {group}) AS n FROM {source}),
 sm AS (SELECT g, count(*) AS n, round(avg(v), 4) AS mean, round(min(v), 4) AS least, round(max(v), 4) AS most, round(coalesce(stddev_samp(v), 0), 4) AS std, round(avg((v > {slow})::INT), 6) AS slow, round(min(v) FILTER (r = least(n, floor(n * 0.95::DOUBLE) + 1)), 4) AS p95, round(min(v) FILTER (r = least(n, floor(n * 0.99::DOUBLE) + 1)), 4) AS p99, round((min(v) FILTER (r = (n + 1) // 2) + min(v) FILTER (r = n // 2 + 1)) / 2, 4) AS median FROM sr GROUP BY g)"""


@query("g2_embedding_stats", "SELECT count(*) AS n, max(len(embedding)) AS dims, round(count(*) * max(len(embedding)) * 4 / 1048576, 6) AS mb, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 4) AS mean_norm FROM embeddings")
def _(spark, d):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return D.table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dims"), F.round(F.count("*") * F.max(F.size("embedding")) * 4 / 1048576, 6).alias("mb"), F.round(F.avg(norm), 4).alias("mean_norm"))


@query("g5_search_totals", f"WITH {LOG} SELECT count(*) AS n, count(*) FILTER (success) AS succeeded, round(avg(success::INT), 6) AS success_rate, round(avg((NOT success)::INT), 6) AS error_rate, round(avg(results) FILTER (success), 6) AS mean_results, round(avg(latency_ms), 4) AS mean_latency FROM log")
def _(spark, d):
    return M.totals(D.search_log(spark, d))


@query("g6_metric_summary", f"WITH {LOG}, {_summary_sql('log', 'event_type', 'latency_ms', '2000')} SELECT g AS event_type, * EXCLUDE (g) FROM sm")
def _(spark, d):
    return M.summary(D.search_log(spark, d), "event_type", "latency_ms", M.LATENCY_MS)


@query("g7_query_pattern_stats", f"WITH {LOG}, u AS (SELECT count(DISTINCT query) AS unique_queries, round(avg(length(query)), 4) AS mean_length, min(length(query)) AS least_length, max(length(query)) AS most_length FROM log) SELECT query, count(*) AS n, round(avg(latency_ms), 4) AS mean_latency, round(avg(results), 4) AS mean_results, any_value(unique_queries) AS unique_queries, any_value(mean_length) AS mean_length, any_value(least_length)::BIGINT AS least_length, any_value(most_length)::BIGINT AS most_length FROM log, u GROUP BY 1 ORDER BY n DESC, query LIMIT 20")
def _(spark, d):
    """The 20 most frequent queries, and beside each the figures of all."""
    g = D.search_log(spark, d).groupBy("query").agg(F.count("*").alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.round(F.avg("results"), 4).alias("mean_results"))
    n = F.length("query")
    whole = g.agg(F.count("query").alias("unique_queries"), F.round(F.sum(n * F.col("n")) / F.sum("n"), 4).alias("mean_length"), F.min(n).cast("long").alias("least_length"), F.max(n).cast("long").alias("most_length"))
    return g.orderBy(F.desc("n"), "query").limit(20).join(F.broadcast(whole), F.lit(True))


@query("g8_health_rules", f"WITH {LOG}, r AS (SELECT latency_ms, success, row_number() OVER (ORDER BY latency_ms) AS r, count(*) OVER () AS n FROM log), s AS (SELECT round(min(latency_ms) FILTER (r = least(n, floor(n * 0.95::DOUBLE) + 1)), 4) AS p95, round(avg((NOT success)::INT), 6) AS error_rate FROM r) SELECT p95, error_rate, CASE WHEN error_rate > 0.05 THEN 'poor' WHEN p95 > 2000 THEN 'degraded' ELSE 'good' END AS health FROM s")
def _(spark, d):
    return M.health(D.search_log(spark, d))


_PRICE = "CASE conv_id % 4 WHEN 0 THEN {}::DOUBLE WHEN 1 THEN {}::DOUBLE WHEN 2 THEN {}::DOUBLE ELSE {}::DOUBLE END"


@query("g9_usage_and_cost", f"WITH t AS (SELECT {_list(M.PRICES)}[conv_id % 4 + 1] AS model, role, {_TOK} AS t FROM conversations), u AS (SELECT model, count(*) AS n, coalesce(sum(t) FILTER (role <> 'assistant'), 0)::BIGINT AS input, coalesce(sum(t) FILTER (role = 'assistant'), 0)::BIGINT AS output FROM t GROUP BY 1) SELECT *, round(input / 1e6 * CASE model {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {p[0]}::DOUBLE' for m, p in M.PRICES.items())} END + output / 1e6 * CASE model {' '.join(f'WHEN {chr(39)}{m}{chr(39)} THEN {p[1]}::DOUBLE' for m, p in M.PRICES.items())} END, 8) AS cost FROM u")
def _(spark, d):
    model = F.element_at(F.array(*map(F.lit, M.PRICES)), (F.col("conv_id") % 4 + 1).cast("int")).alias("model")
    t = D.table(spark, d, "conversations").select(model, "role", T.tokens_chunk("text").alias("t"))
    u = t.groupBy("model").agg(F.count("*").alias("n"), F.sum(F.when(F.col("role") != "assistant", F.col("t")).otherwise(0)).alias("input"), F.sum(F.when(F.col("role") == "assistant", F.col("t")).otherwise(0)).alias("output"))
    price = lambda i: F.create_map(*[F.lit(x) for m, p in M.PRICES.items() for x in (m, p[i])])[F.col("model")]
    return u.withColumn("cost", F.round(F.col("input") / 1e6 * price(0) + F.col("output") / 1e6 * price(1), 8))


@query("g10_tokens_by_role", f"SELECT conv_id, coalesce(sum({_TOK} + 4) FILTER (role IN ('system', 'user')), 0)::BIGINT AS input, coalesce(sum({_TOK} + 4) FILTER (role = 'assistant'), 0)::BIGINT AS context, sum({_TOK} + 4)::BIGINT AS total FROM conversations GROUP BY 1")
def _(spark, d):
    t = T.tokens_chunk("text") + 4
    of = lambda c: F.sum(F.when(c, t).otherwise(0))
    return D.table(spark, d, "conversations").groupBy("conv_id").agg(of(F.col("role").isin("system", "user")).alias("input"), of(F.col("role") == "assistant").alias("context"), F.sum(t).alias("total"))


@query("g11_completion_estimate", f"SELECT conv_id, turn, floor(least(1000, greatest(50, 0.5::DOUBLE * {_TOK})) * (1 + 0.2::DOUBLE * (conv_id % 10) / 10))::BIGINT AS estimate FROM conversations WHERE role = 'user'")
def _(spark, d):
    clamp = F.least(F.lit(1000.0), F.greatest(F.lit(50.0), 0.5 * T.tokens_chunk("text")))
    return D.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.floor(clamp * (1 + F.lit(0.2) * (F.col("conv_id") % 10) / 10)).alias("estimate"))


_HITS = """rq AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
 fd AS (SELECT user_id, event_type, event_id, r, t AS made, false AS hit FROM rq WHERE r = 1 UNION ALL SELECT q.user_id, q.event_type, q.event_id, q.r, CASE WHEN q.t - f.made < 86400000000 THEN f.made ELSE q.t END, q.t - f.made < 86400000000 FROM fd f JOIN rq q ON q.user_id = f.user_id AND q.event_type = f.event_type AND q.r = f.r + 1)"""


@query("k6_ttl_cache_labels", f"WITH RECURSIVE {_HITS} SELECT user_id, event_type, event_id, hit FROM fd")
def _(spark, d):
    return M.cache_labels(D.search_log(spark, d), ["user_id", "event_type"], 86400)


@query("g12_access_log_cache_report", f"WITH RECURSIVE {_HITS} SELECT event_type, count(*) AS requests, count(*) FILTER (NOT hit) AS entries, round(avg(hit::INT), 6) AS hit_rate FROM fd GROUP BY 1")
def _(spark, d):
    h = M.cache_labels(D.search_log(spark, d), ["user_id", "event_type"], 86400)
    return h.groupBy("event_type").agg(F.count("*").alias("requests"), F.count_if(~F.col("hit")).alias("entries"), M.share(F.col("hit")).alias("hit_rate"))


_SEVERITY = {"critical": 75, "high": 50, "medium": 25}


@query("g13_error_stats", f"WITH e AS (SELECT user_id % 5 AS category, CASE {' '.join(f'WHEN value > {v} THEN {chr(39)}{k}{chr(39)}' for k, v in _SEVERITY.items())} ELSE 'low' END AS severity, ts FROM events WHERE event_type = 'error'), c AS (SELECT category, count(*) AS n FROM e GROUP BY 1), m AS (SELECT category AS most FROM c ORDER BY n DESC, category LIMIT 1), t AS (SELECT count(*) AS total FROM e) SELECT category, severity, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') AS last_day, total, category = most AS most_common FROM e, m, t GROUP BY category, severity, total, most")
def _(spark, d):
    """By category and severity, which follows the value; the most common category, and the total beside every row."""
    severity = F.lit("low")
    for name, least in reversed(_SEVERITY.items()):
        severity = F.when(F.col("value") > least, name).otherwise(severity)
    e = D.table(spark, d, "events").where("event_type = 'error'").select((F.col("user_id") % 5).alias("category"), severity.alias("severity"), "ts")
    by = e.groupBy("category", "severity").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")).alias("last_day"))
    whole = by.groupBy("category").agg(F.sum("n").alias("own")).agg(F.sum("own").alias("total"), F.max_by("category", F.struct("own", -F.col("category"))).alias("most"))
    return by.join(F.broadcast(whole), F.lit(True)).select("category", "severity", "n", "last_day", "total", (F.col("category") == F.col("most")).alias("most_common"))


@query("g14_session_store_stats", "SELECT count(*) AS sessions, sum(n)::BIGINT AS turns, max(n) AS longest, round(sum(chars) * 3 / 1048576, 6) AS mb FROM (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1)")
def _(spark, d):
    s = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return s.agg(F.count("*").alias("sessions"), F.sum("n").alias("turns"), F.max("n").alias("longest"), F.round(F.sum("chars") * 3 / 1048576, 6).alias("mb"))


@query("g15_conversation_stats", "SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS user, count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY 1")
def _(spark, d):
    roles = ["user", "assistant", "system"]
    return D.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("role") == r).alias(r) for r in roles])


_PAIRS = "nx AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r, lead(text) OVER w AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), pr AS (SELECT conv_id, turn, text AS question, reply, sha256(conv_id || ':' || turn) AS turn_id FROM nx WHERE role = 'user' AND r = 'assistant')"
_WS = "list_filter(list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda w: length(w) > 0)), lambda w: w NOT IN ('" + "', '".join(M.COMMON_WORDS) + "'))"
_COUNT = lambda g: "(" + " + ".join(f"contains(lower(reply), '{w}')::INT" for w in g) + ")"
_RESPONSE = rf"""{_PAIRS}, wd AS (SELECT *, {_WS.format('question')} AS a, {_WS.format('reply')} AS b, len(list_filter(regexp_split_to_array(question, '\s+'), lambda w: length(w) > 0)) AS nq, len(list_filter(regexp_split_to_array(reply, '\s+'), lambda w: length(w) > 0)) AS nr, len(string_split(reply, '.')) AS ns, {_COUNT(M.CASUAL)} AS cas, {_COUNT(M.POLITE)} AS pol FROM pr),
 sc AS (SELECT conv_id, turn, round(CASE WHEN len(a) = 0 THEN 1 ELSE least(1, len(list_intersect(a, b)) / len(a) + 0.3::DOUBLE) END, 6) AS relevance, CASE WHEN len(list_filter(a, lambda w: length(w) >= 8)) > 0 THEN round(len(list_filter(a, lambda w: length(w) >= 8 AND contains(lower(reply), w))) / len(list_filter(a, lambda w: length(w) >= 8)), 6) ELSE 0.8::DOUBLE END AS accuracy, round(CASE WHEN nr < nq * 2 THEN 0.3::DOUBLE WHEN nr < nq * 5 THEN 0.6::DOUBLE ELSE least(1, 0.8::DOUBLE + nr / (nq * 10) * 0.2::DOUBLE) END, 6) AS completeness,
 round(least(1, 0.5::DOUBLE + CASE WHEN ns > 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(reply, '[•*-]|1\.|2\.') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN nr / ns BETWEEN 10 AND 25 THEN 0.1::DOUBLE ELSE 0 END), 6) AS clarity, round(CASE WHEN cas > 0 THEN greatest(0.3::DOUBLE, 0.7::DOUBLE - cas * 0.1::DOUBLE) ELSE least(1, 0.7::DOUBLE + pol * 0.05::DOUBLE) END, 6) AS tone,
 CASE WHEN contains(lower(reply), 'according to') OR contains(lower(reply), 'source:') THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS sources FROM wd), so AS (SELECT *, round(0.0::DOUBLE + {' + '.join(f'{k} * {w}::DOUBLE' for k, w in M.RESPONSE_WEIGHTS.items())}, 8) AS overall FROM sc)"""


def _scores(spark, d):
    """A right reply holds the long words of its question."""
    expected = F.filter(F.array_distinct(F.split(F.lower("question"), r"\s+")), lambda w: F.length(w) >= 8)
    return M.response_scores(M.pair_turns(D.table(spark, d, "conversations")).withColumn("expected", expected), "expected")


@query("g16_score_response", f"WITH {_RESPONSE} SELECT * FROM so")
def _(spark, d):
    return _scores(spark, d).drop("question", "reply", "turn_id", "expected")


@query("g17_score_batch_report", f"WITH {_RESPONSE} SELECT metric, count(*) AS n, round(avg((v >= 0.7)::INT), 6) AS passing, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most FROM (UNPIVOT (SELECT relevance, accuracy, completeness, clarity, tone, sources, overall FROM so) ON COLUMNS(*) INTO NAME metric VALUE v) GROUP BY 1")
def _(spark, d):
    s = _scores(spark, d)
    long = s.unpivot("turn_id", [*M.RESPONSE_WEIGHTS, "overall"], "metric", "v")
    return long.groupBy("metric").agg(F.count("*").alias("n"), M.share(F.col("v") >= 0.7).alias("passing"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("g18_benchmark_stats", f"WITH {LOG}, r AS (SELECT event_type, latency_ms AS v, row_number() OVER (PARTITION BY event_type ORDER BY latency_ms) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM log), p AS (SELECT *, n * 1.0::DOUBLE * 0.95::DOUBLE + 0.95::DOUBLE AS a95, n * 1.0::DOUBLE * 0.99::DOUBLE + 0.99::DOUBLE AS a99 FROM r), q AS (SELECT event_type, any_value(a95) AS a95, any_value(a99) AS a99, min(v) FILTER (r = greatest(1, least(floor(a95), n))) AS x95, min(v) FILTER (r = greatest(1, least(floor(a95) + 1, n))) AS y95, min(v) FILTER (r = greatest(1, least(floor(a99), n))) AS x99, min(v) FILTER (r = greatest(1, least(floor(a99) + 1, n))) AS y99 FROM p GROUP BY 1) SELECT event_type, round(x95 + (y95 - x95) * (a95 - floor(a95)), 4) AS p95, round(x99 + (y99 - x99) * (a99 - floor(a99)), 4) AS p99 FROM q")
def _(spark, d):
    return M.exclusive_quantile(D.search_log(spark, d), "event_type", "latency_ms", {"p95": 0.95, "p99": 0.99})


@query("g20_collection_stats", "SELECT count(*) AS n, max(len(embedding)) AS dims, min(len(embedding)) = max(len(embedding)) AS uniform, count(DISTINCT label) AS labels FROM embeddings")
def _(spark, d):
    n = F.size("embedding")
    return D.table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.max(n).cast("long").alias("dims"), (F.min(n) == F.max(n)).alias("uniform"), F.count_distinct("label").alias("labels"))


@query("g21_stream_metrics", "SELECT user_id, count(*) AS tokens, sum(octet_length(encode(props)))::BIGINT AS bytes, epoch_us(min(ts)) AS first_us, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, round(count(*) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 0), 8) AS per_second FROM events GROUP BY 1")
def _(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = D.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("tokens"), F.sum(F.octet_length("props")).alias("bytes"), F.min(us).alias("first_us"), ((F.max(us) - F.min(us)) / 1e6).alias("s"))
    return e.select("user_id", "tokens", "bytes", "first_us", F.round("s", 6).alias("seconds"), F.round(F.try_divide("tokens", "s"), 8).alias("per_second"))


@query("g22_parallel_efficiency", f"WITH {LOG} SELECT event_id, round((latency_ms + 100 * results) / nullif(latency_ms, 0), 6) AS speed_up, round((latency_ms + 100 * results) / nullif(latency_ms, 0) / (1 + results), 6) AS efficiency FROM log")
def _(spark, d):
    """One task and one for each result; run one after the other, each further task would have taken 100 ms."""
    up = F.try_divide(F.col("latency_ms") + 100 * F.col("results"), F.col("latency_ms"))
    return D.search_log(spark, d).select("event_id", F.round(up, 6).alias("speed_up"), F.round(up / (1 + F.col("results")), 6).alias("efficiency"))


@query("g23_speedup_report", f"WITH {LOG}, a AS (SELECT avg(latency_ms) FILTER (success) AS ok, avg(latency_ms) AS every, avg(1 + results) AS tasks FROM log) SELECT round(every / ok, 6) AS cache, round(sqrt(tasks), 6) AS parallel, round(1 - 1 / (every / ok * sqrt(tasks)), 6) AS cut FROM a")
def _(spark, d):
    a = D.search_log(spark, d).agg(F.avg(F.when(F.col("success"), F.col("latency_ms"))).alias("ok"), F.avg("latency_ms").alias("every"), F.avg(1 + F.col("results")).alias("tasks"))
    cache, parallel = F.col("every") / F.col("ok"), F.sqrt("tasks")
    return a.select(F.round(cache, 6).alias("cache"), F.round(parallel, 6).alias("parallel"), F.round(1 - 1 / (cache * parallel), 6).alias("cut"))


@query("g24_export_conversation", "SELECT conv_id, md5('# Conversation ' || conv_id || chr(10) || count(*) || ' messages' || chr(10) || string_agg('**' || role || '**: ' || text, chr(10) ORDER BY turn)) AS export_md5 FROM conversations GROUP BY 1")
def _(spark, d):
    line = F.struct("turn", F.concat(F.lit("**"), "role", F.lit("**: "), "text").alias("x"))
    g = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["x"]), "\n").alias("b"))
    return g.select("conv_id", F.md5(F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.col("n").cast("string"), F.lit(" messages\n"), "b")).alias("export_md5"))


@query("g25_request_outcome_report", f"WITH {LOG} SELECT count(*) AS n, count(*) FILTER (NOT success) AS failed, round(avg(latency_ms) FILTER (success), 4) AS mean_ok, round(max(latency_ms), 4) AS most, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 8) AS per_second FROM log")
def _(spark, d):
    us = F.unix_micros("ts")
    return D.search_log(spark, d).agg(F.count("*").alias("n"), F.count_if(~F.col("success")).alias("failed"), F.round(F.avg(F.when(F.col("success"), F.col("latency_ms"))), 4).alias("mean_ok"), F.round(F.max("latency_ms"), 4).alias("most"), F.round(F.count("*") / ((F.max(us) - F.min(us)) / 1e6), 8).alias("per_second"))


@query("h1_recent_turns", f"SELECT conv_id, turn, role FROM {MSG} QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5")
def _(spark, d):
    return M.recent(D.table(spark, d, "conversations"), "conv_id", "turn", 5).select("conv_id", "turn", "role")


@query("h2_fit_context_window", f"WITH t AS (SELECT conv_id, turn, role, {_TOK} + 4 AS t FROM conversations), s AS (SELECT *, sum(CASE WHEN role = 'system' THEN t ELSE 0 END) OVER (PARTITION BY conv_id) AS s, sum(CASE WHEN role <> 'system' THEN t ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS u FROM t) SELECT conv_id, turn, role FROM s WHERE role = 'system' OR u + s <= 400")
def _(spark, d):
    return M.fit_window(D.table(spark, d, "conversations"), T.tokens_chunk("text"), 400).select("conv_id", "turn", "role")


@query("h3_pair_turns", f"WITH {_PAIRS} SELECT conv_id, turn, question, reply, turn_id FROM pr")
def _(spark, d):
    return M.pair_turns(D.table(spark, d, "conversations"))


@query("h4_history_window", "SELECT conv_id, string_agg(role || ': ' || text[1:50], chr(10) ORDER BY turn) AS history FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY 1")
def _(spark, d):
    line = F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 50)).alias("x"))
    return M.recent(D.table(spark, d, "conversations"), "conv_id", "turn", 6).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["x"]), "\n").alias("history"))


@query("h5_metric_trends", f"WITH {LOG}, sp AS (SELECT unnest(range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS period), g AS (SELECT date_trunc('day', ts) AS period, count(*) AS n, avg(latency_ms) AS mean, max(latency_ms) AS most FROM log WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-10' GROUP BY 1) SELECT epoch(period)::BIGINT AS period, coalesce(n, 0) AS n, coalesce(round(mean, 4), 0) AS mean, coalesce(round(most, 4), 0) AS most FROM sp LEFT JOIN g USING (period)")
def _(spark, d):
    return M.trends(D.search_log(spark, d), "latency_ms", "ts", "2024-01-01 00:00:00", "2024-02-10 00:00:00", "1 day").withColumn("period", F.unix_timestamp("period"))


@query("h6_date_separators", "SELECT event_id, coalesce(lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> ts::DATE, true) AS is_first FROM events")
def _(spark, d):
    day = F.to_date("ts")
    return D.table(spark, d, "events").select("event_id", F.coalesce(F.lag(day).over(W.partitionBy("user_id").orderBy("ts", "event_id")) != day, F.lit(True)).alias("is_first"))


@query("h7_expire_sessions", "SELECT user_id, epoch(date_trunc('second', max(ts)))::BIGINT AS last FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-25' ORDER BY max(ts) DESC, user_id LIMIT 100")
def _(spark, d):
    s = D.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("ts")).where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    return s.orderBy(F.desc("ts"), "user_id").limit(100).select("user_id", F.unix_timestamp("ts").alias("last"))


@query("h8_flush_intervals", "WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events) SELECT user_id, count(g) AS n, round(avg(g) / 1e6, 4) AS mean, min(g) AS least, max(g) AS most FROM g GROUP BY 1")
def _(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    g = D.table(spark, d, "events").select("user_id", (us - F.lag(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))).alias("g"))
    return g.groupBy("user_id").agg(F.count("g").alias("n"), F.round(F.avg("g") / 1e6, 4).alias("mean"), F.min("g").alias("least"), F.max("g").alias("most"))


@query("d34_conversation_sections", "WITH s AS (SELECT *, CASE WHEN lag(role) OVER w = role AND length(text) < 500 AND length(lag(text) OVER w) < 500 THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM s) SELECT conv_id, grp::BIGINT AS grp, min(turn) AS first, count(*) AS n, any_value(role) AS role FROM g GROUP BY 1, 2")
def _(spark, d):
    return M.message_groups(D.table(spark, d, "conversations"))


@query("c23_clean_response", r"SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\n{2,}', chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?i)^\s*(?:answer|response):\s*', ''))) AS clean_md5 FROM conversations WHERE role = 'assistant'")
def _(spark, d):
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\n{2,}", "\n"), r"[ \t]+", " "), r"(?i)^\s*(?:answer|response):\s*", "")
    return D.table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.md5(F.trim(out)).alias("clean_md5"))


@query("e4_project_enrichment", "SELECT doc_id, source, n.n_name AS region, lower(n.n_name) || ',' || lang AS tags FROM documents LEFT JOIN nation n ON n.n_nationkey = doc_id % 25")
def _(spark, d):
    n = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("region"))
    docs = D.table(spark, d, "documents")
    return docs.join(n, docs.doc_id % 25 == n.k, "left").select("doc_id", "source", "region", F.concat_ws(",", F.lower("region"), "lang").alias("tags"))


@query("e5_contributors", "WITH r AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events QUALIFY r <= 5) SELECT event_type, user_id, count(*) AS commits FROM r GROUP BY 1, 2")
def _(spark, d):
    r = D.table(spark, d, "events").withColumn("r", F.row_number().over(W.partitionBy("event_type").orderBy("event_id"))).where("r <= 5")
    return r.groupBy("event_type", "user_id").agg(F.count("*").alias("commits"))


@query("e6_restrict_to_projects", "SELECT doc_id, source FROM documents WHERE source IN (SELECT DISTINCT 'src' || (user_id % 5) FROM events)")
def _(spark, d):
    allowed = D.table(spark, d, "events").select(F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source")).distinct()
    return D.table(spark, d, "documents").join(allowed, "source", "left_semi").select("doc_id", "source")


@query("e3_zip_chunks_embeddings", "SELECT d.doc_id, e.vec_id, len(embedding) AS dims, label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id")
def _(spark, d):
    e = D.table(spark, d, "embeddings")
    return D.table(spark, d, "documents").join(e, F.col("doc_id") == F.col("vec_id")).select("doc_id", "vec_id", F.size("embedding").cast("long").alias("dims"), "label")


@query("j2_array_set_ops", f"WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{T.WORD}')) AS a, ['the', 'and', 'der', 'que', 'le', 'tion'] AS b FROM documents) SELECT doc_id, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS either, len(list_filter(a, lambda x: x NOT IN ('the', 'and', 'der', 'que', 'le', 'tion'))) AS only_a FROM w")
def _(spark, d):
    a, b = F.array_distinct(T.words("text")), F.array(*map(F.lit, ["the", "and", "der", "que", "le", "tion"]))
    return D.table(spark, d, "documents").select("doc_id", F.size(F.array_intersect(a, b)).cast("long").alias("both"), F.size(F.array_union(a, b)).cast("long").alias("either"), F.size(F.array_except(a, b)).cast("long").alias("only_a"))


@query("j3_delete_by_key", "SELECT doc_id, source FROM documents WHERE doc_id % 10 < 7 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 10 >= 3)")
def _(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "source")
    return docs.where("doc_id % 10 < 7").join(docs.where("doc_id % 10 >= 3").select("doc_id"), "doc_id", "left_anti")


@query("k1_usage_per_minute", "WITH u AS (SELECT user_id, date_trunc('minute', ts) AS m, count(*) AS requests, sum(length(props))::BIGINT AS tokens FROM events GROUP BY 1, 2) SELECT user_id, epoch(m)::BIGINT AS minute, requests, tokens, round(requests / 30, 6) AS utilisation, requests > 30 OR tokens > 50000 AS refused FROM u")
def _(spark, d):
    e = D.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    u = e.groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("requests"), F.sum(F.length("props")).alias("tokens"))
    return u.select("user_id", F.unix_timestamp("w.start").alias("minute"), "requests", "tokens", F.round(F.col("requests") / 30, 6).alias("utilisation"), ((F.col("requests") > 30) | (F.col("tokens") > 50000)).alias("refused"))


@query("k3_flush_groups", "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS flush FROM events")
def _(spark, d):
    r = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return D.table(spark, d, "events").select("event_id", "user_id", F.floor(r / 10).alias("flush"))


@query("k4_metric_rollup_retention", "SELECT event_type, epoch(time_bucket(INTERVAL 5 MINUTE, ts))::BIGINT AS start, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1, 2")
def _(spark, d):
    e = D.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") >= F.lit("2024-01-24").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")).select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "mean")


@query("k5_alerts_with_cooldown", f"""WITH RECURSIVE {LOG}, c AS (SELECT user_id, event_id, epoch_us(ts) AS t, latency_ms, success, sum((NOT success)::INT) OVER w AS bad, count(*) OVER w AS n FROM log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT user_id, 'high_latency' AS alert, event_id, t FROM c WHERE latency_ms > 4000 UNION ALL SELECT user_id, 'high_error_rate', event_id, t FROM c WHERE NOT success AND bad > n * 0.1::DOUBLE), a AS (SELECT *, row_number() OVER (PARTITION BY user_id, alert ORDER BY t, event_id) AS r FROM p),
 f AS (SELECT user_id, alert, event_id, r, t AS last, true AS fired FROM a WHERE r = 1 UNION ALL SELECT a.user_id, a.alert, a.event_id, a.r, CASE WHEN a.t - f.last > 900000000 THEN a.t ELSE f.last END, a.t - f.last > 900000000 FROM f JOIN a ON a.user_id = f.user_id AND a.alert = f.alert AND a.r = f.r + 1) SELECT user_id, alert, event_id FROM f WHERE fired""")
def _(spark, d):
    """At most one alert of a user and kind in 15 minutes."""
    return M.cooled_alerts(M.alert_points(D.search_log(spark, d), "user_id"), ["user_id", "alert"], 900)


@query("k7_session_by_inactivity", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 24 HOUR THEN 0 ELSE 1 END AS n FROM events), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) AS last, count(*) AS n FROM g GROUP BY user_id, g")
def _(spark, d):
    e = D.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "24 hours").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    return s.select("user_id", F.unix_micros("a").alias("start"), F.unix_micros("b").alias("last"), "n")


@query("k9_streaming_token_totals", "SELECT user_id, count(*) AS tokens, sum(length(props))::BIGINT AS chars FROM events GROUP BY 1")
def _(spark, d):
    return D.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("tokens"), F.sum(F.length("props")).alias("chars"))



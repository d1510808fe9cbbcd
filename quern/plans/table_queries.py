"""Queries over files, tables of versions, links and streams' batch twins, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import tabular
from quern.functions import text as T
from quern.operators import chunking as C
from quern.operators import code
from quern.operators import links
from quern.operators import metrics as M
from quern.operators import search as S
from quern.sources import derived as D
from quern.sources import tables
from quern.sources.scratch import new_path
from quern.sources.versioned import VersionedTable
from quern.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("a4_jsonl_chunk_io", f"WITH {D.chunks_sql()} SELECT doc_id || '-' || chunk_index AS chunk_id, doc_id::VARCHAR AS source_document, chunk_index, length(content) AS char_count, md5(content) AS text_md5 FROM chunks")
def _(spark, d):
    """Written as JSON lines and read back with a stated schema."""
    c = D.chunks(spark, d).select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").cast("string").alias("source_document"), "chunk_index", F.col("content").alias("text"), F.length("content").cast("long").alias("char_count"))
    path = new_path(spark)
    tables.write_jsonl(c, path)
    return tables.read_jsonl(spark, path).select("chunk_id", "source_document", "chunk_index", "char_count", F.md5("text").alias("text_md5"))


@query("a5_reindex_by_file", "WITH o AS (SELECT doc_id, source, length(text) AS n FROM documents WHERE doc_id % 10 < 7), n AS (SELECT doc_id, source, length(text) + 1 AS n FROM documents WHERE doc_id % 10 >= 3) SELECT * FROM n UNION ALL SELECT * FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def _(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return tables.upsert(docs.where("doc_id % 10 < 7"), docs.where("doc_id % 10 >= 3").withColumn("n", F.col("n") + 1), ["doc_id"])


@query("a6_changed_file_selection", "SELECT doc_id, sha256(text) AS version FROM documents WHERE doc_id % 10 >= 7 OR doc_id % 10 = 5")
def _(spark, d):
    docs = D.table(spark, d, "documents")
    known = docs.where("doc_id % 10 < 7").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("version"))
    return tables.changed(docs.select("doc_id", "text"), known, "doc_id", "text").select("doc_id", "version")


@query("a7_index_reconciliation", "SELECT source, count(*) AS indexed, count(*) + 1 AS recorded FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1")
def _(spark, d):
    docs = D.table(spark, d, "documents")
    recorded = docs.groupBy("source").agg((F.count("*") + F.max(F.col("source").isin("src1", "src2").cast("int"))).alias("recorded"))
    return tables.reconcile(docs, recorded, "source")


@query("a8_metrics_export", f"WITH {D.SEARCH_LOG_SQL} SELECT event_type AS metric, event_id, round(latency_ms, 4) AS value FROM log WHERE ts >= TIMESTAMP '2024-01-25'")
def _(spark, d):
    path = new_path(spark)
    points = D.search_log(spark, d).select("ts", F.col("event_type").alias("metric"), "event_id", F.round("latency_ms", 4).alias("value"))
    tables.export_metrics(points, path, "2024-01-25 00:00:00", "csv")
    back = spark.read.schema("ts string, event_id long, value double, metric string").option("header", True).csv(path)
    return back.select("metric", "event_id", "value")


@query("a9_pipeline_flow_report", f"""WITH {D.chunks_sql()}, n AS (SELECT 'documents' AS stage, 0 AS place, count(*) AS n, false AS same FROM documents UNION ALL SELECT 'chunks', 1, count(*), false FROM chunks
 UNION ALL SELECT 'embeddings', 2, count(*) FILTER (len(regexp_extract_all(lower(content), '{T.WORD}')) > 0), true FROM chunks UNION ALL SELECT 'stored', 3, count(DISTINCT (doc_id, chunk_index)) FILTER (len(regexp_extract_all(lower(content), '{T.WORD}')) > 0), true FROM chunks),
 p AS (SELECT stage, place, n, NOT same OR n = lag(n) OVER (ORDER BY place) AS passed FROM n) SELECT stage, place::BIGINT AS place, 'SUCCESS' AS status, n, passed FROM p UNION ALL SELECT 'overall', 4, 'SUCCESS', max_by(n, place), bool_and(passed) FROM p""")
def _(spark, d):
    """Documents, chunks, a vector for each chunk, and the vectors stored under one id for each chunk; seconds are left out here."""

    def stored(vectors):
        table = VersionedTable(spark, f"{path}/store", vectors.schema, ["doc_id"], buckets=16)
        table.merge(vectors, 0)
        return table.read()

    path = new_path(spark, "flow")
    stages = [
        tables.Stage("documents", lambda _: D.table(spark, d, "documents")),
        tables.Stage("chunks", lambda _: D.chunks(spark, d).select(F.concat_ws("-", "doc_id", "chunk_index").alias("doc_id"), "content")),
        tables.Stage("embeddings", lambda c: S.hashed_embedding(c, "content"), same=True),
        tables.Stage("stored", stored, same=True),
    ]
    return tables.run_flow(spark, stages, path)[0].select("stage", "place", "status", "n", "passed")


@query("k8_incremental_index_stream", SQL["a5_reindex_by_file"])
def _(spark, d):
    """The batches of a5 landed as files one after the other, each found by a stream that merges it into a table of versions."""
    docs = D.table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("long").alias("n"))
    base = new_path(spark, "index")
    table = VersionedTable(spark, f"{base}/table", docs.schema, ["doc_id"], buckets=64)
    for number, part in enumerate([docs.where("doc_id % 10 < 7"), docs.where("doc_id % 10 >= 3").withColumn("n", F.col("n") + 1)]):
        part.write.parquet(f"{base}/landed/batch={number}")
        stream = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).parquet(f"{base}/landed")
        jobs.incremental_index(stream, table, f"{base}/checkpoint").awaitTermination()
    return table.read()


@query("a10_benchmark_csv_scan", f"WITH {D.SEARCH_LOG_SQL} SELECT event_id::VARCHAR AS timestamp, query[1:50] AS query, round(latency_ms, 2) AS total_time_ms, results AS sources_found FROM log")
def _(spark, d):
    log = D.search_log(spark, d)
    ms = F.round("latency_ms", 2)
    rows = log.select(F.col("event_id").cast("string").alias("timestamp"), F.substring("query", 1, 50).alias("query"), ms.alias("total_time_ms"), (ms * 0.5).alias("retrieval_ms"), (ms * 0.2).alias("assembly_ms"), (ms * 0.2).alias("generation_ms"), (ms * 0.1).alias("overhead_ms"), F.lit(0).alias("tokens_used"), F.col("results").alias("sources_found"))
    path = new_path(spark)
    tables.write_csv(rows, path)
    return tables.read_bench_csv(spark, path).select("timestamp", "query", "total_time_ms", "sources_found")


#: Types dealt to pages; besides, every page but the first has a link `up` to the page of half its number.
_TYPES = [t for t, depth in links.DEPTHS.items() if depth]


def edges(spark, d):
    """Links between pages: two for each page, typed by the page, and one up."""
    p = D.table(spark, d, "pages").select(F.col("page_id").alias("src"))
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("src") % len(_TYPES) + 1).cast("int"))
    n = D.table(spark, d, "pages").agg(F.count("*").alias("n"))
    both = p.withColumn("k", F.explode(F.array(F.lit(11), F.lit(22)))).withColumn("one", F.lit(1)).join(F.broadcast(n.withColumn("one", F.lit(1))), "one")
    up = p.where("src > 0").select("src", F.lit("up").alias("type"), F.expr("src div 2").alias("dst"))
    return both.select("src", kind.alias("type"), ((F.col("src") + F.col("k")) % F.col("n")).alias("dst")).union(up)


@query("e8_attach_context_documents", f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS src, {_TYPES!r}[page_id % {len(_TYPES)} + 1] AS type, (page_id + k) % n AS dst FROM pages, n, (VALUES (11), (22)) v(k) UNION ALL SELECT page_id, 'up', page_id // 2 FROM pages WHERE page_id > 0), l AS (SELECT unnest({list(links.DEPTHS)!r}) AS type, unnest({[64 if x is None else x for x in links.DEPTHS.values()]!r}) AS most),
r AS (SELECT page_id AS start, e.type, dst AS node, 1 AS depth FROM pages JOIN e ON src = page_id UNION SELECT start, r.type, e.dst, depth + 1 FROM r JOIN e ON e.src = r.node AND e.type = r.type JOIN l ON l.type = r.type WHERE depth < most) SELECT start, type, node, min(depth) AS depth FROM r WHERE start <> node GROUP BY 1, 2, 3""")
def _(spark, d):
    """From every page."""
    starts = D.table(spark, d, "pages").select(F.col("page_id").alias("node"))
    return links.follow(edges(spark, d), starts)


@query("b10_document_content_checks", "WITH c AS (SELECT conv_id, turn, CASE WHEN trim(text) = '' THEN 'empty element' WHEN length(text) > 2000 THEN 'long element' END AS issue FROM conversations) SELECT conv_id, turn, issue FROM c WHERE issue IS NOT NULL")
def _(spark, d):
    """Nested sections of messages, checked element by element, as an issue table."""
    nested = D.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("elements"))
    issue = lambda e: F.struct(e["turn"].alias("turn"), F.when(F.trim(e["text"]) == "", "empty element").when(F.length(e["text"]) > 2000, "long element").alias("issue"))
    return nested.select("conv_id", F.inline(F.filter(F.transform("elements", issue), lambda x: x["issue"].isNotNull())))


@query("c11_extract_categories", r"WITH f AS (SELECT page_id, 'Category: guide' || (page_id % 4) || ' Type: howto' || chr(10) || html AS t FROM pages) SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)(?:category|type|kind):[ ]*([A-Za-z0-9]{3,})', 1), lambda x: lower(x)))), ',') AS categories FROM f")
def _(spark, d):
    made = F.concat(F.lit("Category: guide"), (F.col("page_id") % 4).cast("string"), F.lit(" Type: howto\n"), "html")
    found = F.transform(T._all(made, r"(?i)(?:category|type|kind):[ ]*([A-Za-z0-9]{3,})", 1), F.lower)
    return D.table(spark, d, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("categories"))


def code_shape(c):
    """Distinct indents, bracket balance (a fold with a stack), and the deepest list level of a text."""
    indents = F.transform(F.filter(T.lines(c), lambda x: F.length(F.trim(x)) > 0), lambda x: F.length(x) - F.length(F.ltrim(x)))
    marks = F.split(F.regexp_replace(c, r"[^()\[\]{}]", ""), "")
    pairs = {"(": ")", "[": "]", "{": "}"}

    def push(s, m):
        out = s
        for o, e in pairs.items():
            out = F.when(m == o, F.concat(s, F.lit(o))).when(m == e, F.when(F.endswith(s, F.lit(o)), F.substring(s, F.lit(1), F.length(s) - 1)).otherwise(F.concat(s, F.lit("!")))).otherwise(out)
        return out

    level = F.array_max(F.transform(F.filter(T.lines(c), lambda x: F.ltrim(x).rlike("^[-*+]")), lambda x: F.floor((F.length(x) - F.length(F.ltrim(x))) / 2)))
    return {"indents": F.size(F.array_distinct(indents)).cast("long"), "balanced": F.aggregate(marks, F.lit(""), push) == "", "list_level": F.coalesce(level, F.lit(0)).cast("long")}


@query("c16_code_shape", "SELECT event_id, 1::BIGINT AS indents, true AS balanced, 0::BIGINT AS list_level FROM events")
def _(spark, d):
    return D.table(spark, d, "events").select("event_id", *(c.alias(n) for n, c in code_shape("props").items()))


#: A document's path: its source with an ending by doc_id; six of nine have none that says anything.
_PATH_SQL = "source || CASE doc_id % 9 WHEN 0 THEN '.md' WHEN 1 THEN '.rst' WHEN 2 THEN '.py' ELSE '.txt' END"


@query("c32_detect_content_type", rf"""WITH s AS (SELECT doc_id, text, regexp_extract({_PATH_SQL}, '\.([^./]+)$', 1) AS ending, 3 * regexp_matches(text, '(?m)^#{{1,6}}\s+')::INT + 2 * contains(text, '```')::INT + regexp_matches(text, '\[.*\]\(.*\)')::INT + regexp_matches(text, '(?m)^\s*[-*+]\s+')::INT + regexp_matches(text, '(?m)^\|.*\|$')::INT AS md,
 {' + '.join(f"contains(lower(text), '{x}')::INT" for x in C.CODE_INDICATORS)} AS code, (length(text) - length(replace(replace(text, '{{', ''), '}}', ''))) / greatest(length(text), 1) AS braces, (length(text) - length(replace(text, ';', ''))) / greatest(length(text), 1) AS semis, (length(text) - length(replace(text, chr(10) || chr(10), ''))) / 2 AS blanks FROM documents)
 SELECT doc_id, CASE WHEN ending = 'md' THEN 'markdown' WHEN ending = 'rst' THEN 'structured_text' WHEN ending = 'py' THEN 'code' WHEN md >= 3 THEN 'markdown' WHEN code >= 2 OR braces > 0.01 OR semis > 0.005 THEN 'code' WHEN blanks > length(text) / 200 THEN 'structured_text' WHEN md > 0 AND code > 0 THEN 'mixed' ELSE 'text' END AS kind FROM s""")
def _(spark, d):
    end = F.when(F.col("doc_id") % 9 == 0, ".md").when(F.col("doc_id") % 9 == 1, ".rst").when(F.col("doc_id") % 9 == 2, ".py").otherwise(".txt")
    return D.table(spark, d, "documents").select("doc_id", C.content_kind("text", F.concat("source", end)).alias("kind"))


# What functions, classes and imports look like.
CODE_PATTERNS = {
    "python": [r"(?m)^\s*def\s+\w+\s*\(", r"(?m)^\s*class\s+\w+", r"(?m)^\s*(?:from\s+\S+\s+)?import\s+\w+"],
    "javascript": [r"function\s+\w+\s*\(", r"(?m)^\s*class\s+\w+\s*(?:extends\s+\w+\s*)?\{", r"(?m)^\s*import\s+.*from"],
    "java": [r"(?:public|private|protected)\s+(?:static\s+)?\w+\s+\w+\s*\(", r"(?:public|private)\s+class\s+\w+", r"(?m)^\s*import\s+[\w.]+;"],
}


def programming_language(c):
    """The language with most matches; the first on ties; null without any."""
    scores = F.array(*[F.struct(sum((F.regexp_count(c, F.lit(p)) for p in ps), F.lit(0)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, ps) in enumerate(CODE_PATTERNS.items())])
    best = F.array_max(scores)
    return F.when(best["n"] > 0, best["name"])


@query("c33_detect_programming_language")
def _(spark, d):
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("def run(x):\n    return x\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("public class A {\n  public int run(int x) { return x; }\n}\n"), "text")).otherwise(F.col("text"))
    return D.table(spark, d, "documents").select("doc_id", programming_language(made).alias("language"))


def code_of(spark, d):
    """doc_id, language, code: every line of every document as a function of a class, in five languages by doc_id; the line stands in a comment
    and in a string, where its braces do not count."""
    i = F.col("doc_id") % 5
    language = F.element_at(F.array(*map(F.lit, code.FUNCTIONS)), (i + 1).cast("int"))
    plain = lambda x: F.regexp_replace(x, r"[\\\\\"'`*/]", " ")

    def body(line, n):
        name = F.concat(F.lit("f"), n.cast("string"))
        python = F.concat(F.lit("    def "), name, F.lit("(self, x):\n        # "), plain(line), F.lit("\n\n        return '{"), plain(line), F.lit("'\n"))
        head = F.when(i == 1, F.concat(F.lit("function "), name, F.lit("(x) {"))).when(i == 2, F.concat(F.lit("  public static int "), name, F.lit("(int x) {"))).otherwise(F.concat(F.lit("int "), name, F.lit("(int x) {")))
        braced = F.concat(head, F.lit("\n  // } "), plain(line), F.lit("\n  if (x) { s = \"{ "), plain(line), F.lit("\"; }\n}\n"))
        return F.when(i == 0, python).otherwise(braced)

    inner = F.array_join(F.transform(F.split("text", "\n"), body), "")
    made = F.when(i == 0, F.concat(F.lit("class Made:\n"), inner)).when(i == 4, inner).otherwise(F.concat(F.lit("class Made {\n"), inner, F.lit("}\n")))
    return D.table(spark, d, "documents").select("doc_id", language.alias("language"), made.alias("code"))


@query("d7_code_elements")
def _(spark, d):
    """Functions and classes in code made of whole documents, in five languages."""
    return code.code_elements(code_of(spark, d), "code", "language")


@query("d13_chunk_adaptive")
def _(spark, d):
    return C.adaptive(D.markdown(spark, d), "md")


@query("l2_chunk_table_function")
def _(spark, d):
    """The SQL surface: a table function over every document."""
    tabular.register(spark)
    name = f"docs_{uuid.uuid4().hex}"
    D.table(spark, d, "documents").createOrReplaceTempView(name)
    return spark.sql(f"SELECT doc_id, c.chunk_index, c.content FROM {name}, LATERAL chunk(text, 'sentence', 1000) c")


@query("k2_token_bucket_admission")
def _(spark, d):
    """Batch twin of the stateful stream: each user's requests pass in order, with two numbers of state."""
    return M.token_bucket(D.search_log(spark, d), "user_id", 0.5, 60.0)

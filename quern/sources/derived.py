"""Tables derived from the given ones, the same rows in Spark and in DuckDB, for operators whose input the tables do not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings dealt to pages by page_id.
ENDINGS = ["md", "txt", "pdf", "PY", "js", "json", "yml", "png", "sql", "rst", "xyz", "html"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path: a file tree made of the pages' addresses."""
    bare = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("page_id") % len(ENDINGS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(bare, F.lit("."), ending).alias("path"))


FILES_SQL = f"""files AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '.' || {ENDINGS!r}[page_id % {len(ENDINGS)} + 1] AS path FROM pages)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, md: documents written as Markdown with headings, list items and fences."""
    line = lambda l, i: (  # noqa: E731, E741
        F.when(i % 4 == 1, F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n\n"), l))
        .when(i % 4 == 2, F.concat(F.lit("- "), l))
        .when(i % 4 == 3, F.concat(F.lit("```txt\n"), l, F.lit("\n```")))
        .otherwise(l)
    )
    body = F.array_join(F.transform(F.split("text", "\n"), line), "\n\n")
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("# "), "source", F.lit("\n\n"), body).alias("md"))


MARKDOWN_SQL = """md AS (SELECT doc_id, source, '# ' || source || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
  CASE (i-1) % 4 WHEN 1 THEN '## Part ' || (i-1) || chr(10) || chr(10) || l WHEN 2 THEN '- ' || l
                 WHEN 3 THEN '```txt' || chr(10) || l || chr(10) || '```' ELSE l END), chr(10)||chr(10)) AS md FROM documents)"""


def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search of each event: ts, query, latency_ms, results, success, cache_key."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.concat(F.lit("q"), k).alias("query"),
        (F.col("value") * 100).alias("latency_ms"), (F.col("event_id") % 7).alias("results"), (F.col("event_type") != "error").alias("success"),
    )


SEARCH_LOG_SQL = """log AS (SELECT event_id, ts, user_id, event_type, 'q' || json_extract_string(props, '$.k') AS query, value * 100 AS latency_ms, event_id % 7 AS results, event_type <> 'error' AS success FROM events)"""


def chunks(spark: SparkSession, sf_dir: str, size: int = 2000, step: int = 1800) -> DataFrame:
    """doc_id, chunk_index, start, content: fixed windows over the documents' Markdown."""
    from quern.operators import chunking

    return chunking.fixed_windows(markdown(spark, sf_dir), "md", size, step)


def chunks_sql(size: int = 2000, step: int = 1800) -> str:
    return f"""{MARKDOWN_SQL}, cut AS (SELECT doc_id, unnest(range(0, greatest(length(md) - {size - step} - 1, 0) + 1, {step})) AS start, md FROM md),
 chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start, md[start + 1:start + {size}] AS content, least(start + {size}, length(md)) AS stop, length(md) AS doc_length
  FROM cut WHERE trim(md[start + 1:start + {size}], ' ' || chr(10) || chr(9) || chr(13)) <> '')"""


def user_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, query: the first six words of each benchmark item."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), 1, 6), " ").alias("query"))


QUERIES_SQL = r"""q AS (SELECT item_id, array_to_string(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')[1:6], ' ') AS query FROM benchmark)"""

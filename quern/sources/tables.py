"""Landed files in, tables out: text trees, JSON lines, CSV and Parquet, and the upserts between them."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk_id string, source_document string, chunk_index long, text string, char_count long"
BENCH_SCHEMA = "timestamp string, query string, total_time_ms double, retrieval_ms double, assembly_ms double, generation_ms double, overhead_ms double, tokens_used long, sources_found long"


def read_tree(spark: SparkSession, path: str, endings: list[str]) -> DataFrame:
    """path, text of every file below a folder with one of the endings; blank files are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings) & ~F.col("text").rlike(r"^\s*$"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_bench_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH_SCHEMA).option("header", True).csv(path)


def export_metrics(points: DataFrame, path: str, cutoff: str, fmt: str = "json") -> None:
    """Points from the cutoff on, by metric; the cutoff is given, never the clock."""
    recent = points.where(F.col("ts") >= F.lit(cutoff).cast("timestamp"))
    writer = recent.write.mode("overwrite").partitionBy("metric")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys occur in new, and new: running it again changes nothing."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def changed(found: DataFrame, known: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that are unknown or whose content differs from what is recorded."""
    versioned = found.withColumn("version", F.sha2(text, 256))
    return versioned.join(known.select(key, "version"), [key, "version"], "left_anti")


def reconcile(index: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """One row for each key whose counts differ."""
    counts = index.groupBy(key).agg(F.count("*").alias("indexed"))
    both = counts.join(recorded, key, "full").select(key, F.coalesce("indexed", F.lit(0)).alias("indexed"), F.coalesce("recorded", F.lit(0)).alias("recorded"))
    return both.where("indexed <> recorded")


class Stage:
    """A stage of a flow: work(previous stage's table) gives its own table. same: the stage fails if it has not as many rows as the one before."""

    def __init__(self, name: str, work: Callable[[DataFrame | None], DataFrame], same: bool = False):
        self.name, self.work, self.same = name, work, same


_FLOW = "stage string, place long, status string, n long, seconds double, passed boolean, error string"


def run_flow(spark: SparkSession, stages: list[Stage], path: str) -> tuple[DataFrame, DataFrame | None]:
    """A report and the last table. Every stage is written to path/NAME and read back by the next; its rows are counted by an observation while
    they are written, never by a second pass. A stage that raises has failed, and those behind it are skipped. The report has one row a
    stage and one `overall`: passed says, for a stage that must keep the rows of the one before, whether it did; overall has succeeded if no
    stage failed, and passed if all have."""
    rows, table, before = [], None, None
    for place, stage in enumerate(stages):
        if rows and rows[-1][2] != "SUCCESS":
            rows.append((stage.name, place, "SKIPPED", None, None, False, None))
            continue
        seen, began = Observation(f"flow-{stage.name}-{uuid.uuid4().hex}"), time.monotonic()
        try:
            made = stage.work(table)
            made.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{stage.name}")
        except Exception as error:
            rows.append((stage.name, place, "FAILED", None, time.monotonic() - began, False, str(error).split("\n")[0][:200]))
            continue
        n = seen.get["n"]
        rows.append((stage.name, place, "SUCCESS", n, time.monotonic() - began, not stage.same or n == before, None))
        table, before = spark.read.schema(made.schema).parquet(f"{path}/{stage.name}"), n
    good = all(r[2] == "SUCCESS" for r in rows)
    rows.append(("overall", len(stages), "SUCCESS" if good else "FAILED", rows[-1][3], sum(r[4] or 0.0 for r in rows), all(r[5] for r in rows), None))
    return spark.createDataFrame(rows, _FLOW), table if good else None

"""A corpus from raw documents to token ids, in stages that are written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common, op2_bpe, op4_secrets, op5_decontaminate, op6_jaccard, op9_quality
from quern.shipping import shipped


#: Near copies of the pipeline: shingles of five words, similarity 0.8 or more.
WORDS, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the adaptive thresholds reject go."""
    rejected = common.materialize(op9_quality.quality(docs).where(~F.col("kept")).select(*common.KEY).distinct(), "rejected")
    return common.without_rows(docs, rejected)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near and exact copies stays: the one with the smallest id, rows without an id last. Documents without words stay."""
    grouped = common.materialize(op6_jaccard.jaccard_components(docs.select("doc_id", "text"), WORDS, PERCENT), "grouped")
    gone = grouped.where(~F.col("head")).select(*common.KEY).distinct()
    kept = common.without_rows(docs, common.materialize(gone, "copies"))
    # Rows that repeat id and text share a key and a group: of each such key one row stays. Keys that do not repeat are not shuffled.
    again = grouped.where(F.col("n_shingles") > 0).groupBy(*common.KEY).agg(F.count("*").alias("n")).where("n > 1").select(*common.KEY)
    again = common.materialize(again, "repeated")
    if again.isEmpty():
        return kept
    names = common.fresh(kept, *common.KEY)
    keyed = kept.select("*", *common.row_key(names=names))
    once = keyed.join(common.small(again).toDF(*names), names, "left_semi").dropDuplicates(names)
    return common.without_rows(kept, again).union(once.select(*common.quoted(docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    found = op5_decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))
    rejected = common.materialize(found.where("contaminated").select(*common.KEY).distinct(), "rejected")
    return common.without_rows(docs, rejected)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows. No document goes."""
    clean = op4_secrets.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of what they decode to."""
    return op2_bpe.digests(docs, public_tokenizers.path(op2_bpe.VOCABULARY), public_tokenizers.PATTERN, ["doc_id", "lang", "source"])


def _stage(work):
    """work with the package on the executors and texts in short batches."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.short_batches(spark)
        return work(spark, docs, sf_dir)

    return shipped(run)


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("n-gram Jaccard join", _stage(jaccard_join)),
    ("benchmark decontamination", _stage(decontamination)),
    ("secret scans", _stage(secret_scan)),
    ("byte-level BPE", _stage(byte_bpe)),
]
#: Digests of token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    before = []
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(*before)  # nothing reads it any more
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

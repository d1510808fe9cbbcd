"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (unigrams and bigrams, BUCKETS buckets, add-one smoothing) are fitted: the target model
on documents labelled good, the raw model on all documents. A document's weight is the log of their probability ratio, over all its
n-grams. Gumbel noise, drawn by a hash of the document, is added, and the documents with the largest keys are the sample: a draw
without replacement in proportion to the ratio. The top k is found by counting keys in nested ranges, never by sorting all of them.

Cases: null and wordless texts have log ratio 0 and still take part. Ties at the cut are broken by the row key, found by the same
counting; repeated rows share a key and a fate, so the sample may exceed k by copies of its last row. Without good labels the ratio is
that of a uniform target. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, materialize, row_key, slices, small, summed, word_hashes

BUCKETS = 1 << 14
FRACTION = 0.8
SEED = 7
_SPLIT = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the unigrams and bigrams of a text."""
    h = word_hashes((text or "").lower().encode().split())
    with np.errstate(over="ignore"):
        pairs = (h[:-1] * _SPLIT ^ h[1:]) * _SPLIT if len(h) > 1 else h[:0]
    shift = np.uint64(64 - int(np.log2(buckets)))
    return np.concatenate([h, pairs]) >> shift


def fit(docs: DataFrame, good: DataFrame) -> tuple[np.ndarray, int]:
    """log(target / raw) of every bucket, and how many documents were good. good: materialized doc_ids."""
    marked = docs.select("doc_id", "text").join(small(good.select("doc_id", F.lit(True).alias("good"))), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)))

    def count(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        for batch in slices(batches):
            for t, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = np.bincount(features(t).astype(np.int64), minlength=BUCKETS)
                totals[0] += n
                if g:
                    totals[1] += n
        rows = [(k << 16 | b, totals[k, b : b + 2048].tobytes()) for k in (0, 1) for b in range(0, BUCKETS, 2048)] if totals.any() else []
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary()))], ["k", "v"])

    totals = np.ones((2, BUCKETS))
    for r in summed(marked.mapInArrow(count, "k int, v binary")).collect():  # two rows of BUCKETS numbers in all
        v, k, b = np.frombuffer(r["v"], np.int64), r["k"] >> 16, r["k"] & 0xFFFF
        totals[k, b : b + len(v)] += v
    p = np.log(totals / totals.sum(1, keepdims=True))
    return p[1] - p[0], good.count()


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """KEY, doc_id, log_ratio (sum over the n-grams) and key (log_ratio plus Gumbel noise)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches):
        r = shared.value
        for batch in slices(batches):
            total = [float(r[features(t).astype(np.int64)].sum()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total, pa.float64())], [*KEY, "doc_id", "log_ratio"])

    scored = docs.select(*row_key(), "doc_id", "text").mapInArrow(score, "__k1 long, __k2 long, doc_id long, log_ratio double")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return scored.withColumn("key", F.col("log_ratio") - F.log(-F.log(uniform)))


def nth(df: DataFrame, value: Column, k: int, width: int = 4096) -> tuple:
    """The k-th largest value (from 1), and how many rows have larger ones. Counts rows in ranges round it and narrows them until it is
    alone; each round is one pass that counts at most `width` ranges."""
    rows = df.select(value.alias("x"))
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    above = 0
    while low != high:
        step = (float(high) - float(low)) / width
        if step:
            cell = F.least(F.floor((F.col("x").cast("double") - float(low)) / step), F.lit(width - 1))
        else:  # neighbouring numbers
            cell = F.when(F.col("x") == high, 1).otherwise(0)
        counts = rows.where((F.col("x") >= low) & (F.col("x") <= high)).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for r in sorted(counts.collect(), key=lambda r: -r["c"]):
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return low, above


def top_k(weighed: DataFrame, k: int) -> DataFrame:
    """weighed (materialized) with `selected`: whether the row is among the k with the largest key, ties by the smaller row key."""
    total = weighed.count()
    if not total or k >= total or k <= 0:
        return weighed.withColumn("selected", F.lit(bool(total) and k >= total))
    chosen, tied = F.lit(False), F.lit(True)
    for value in (F.col("key"), *(F.bitwise_not(c) for c in KEY)):  # ~x orders as -x does, without overflow
        cut, above = nth(weighed.where(tied), value, k)
        k -= above
        chosen, tied = chosen | (tied & (value > F.lit(cut))), tied & (value == F.lit(cut))
    return weighed.withColumn("selected", chosen | tied)


def resample(docs: DataFrame, labels: DataFrame, fraction: float = FRACTION, seed: int = SEED) -> DataFrame:
    """KEY, doc_id, log_ratio, key and selected of every document; a share `fraction` of them is selected."""
    good = materialize(labels.groupBy("doc_id").agg(F.max("quality").alias("q")).where("q = 1").select("doc_id"), "good")
    ratio, _ = fit(docs, good)
    weighed = materialize(weigh(docs, ratio, seed), "weighed")
    return top_k(weighed, round(fraction * weighed.count()))


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = resample(docs, labels)
    return out.select("doc_id", F.round("log_ratio", 6).alias("log_ratio"), F.round("key", 6).alias("gumbel_key"), "selected")

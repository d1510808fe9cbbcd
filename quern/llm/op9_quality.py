"""Quality rules with adaptive thresholds.

Fixed base rules are joined by thresholds that follow each language and source: the ratios below are kept as mergeable quantile
sketches (logarithmic buckets with counts, relative error EPS; merging adds counts, so the sketch of any union is exact to the
bucket and does not depend on the order of rows). A value fails if it is beyond a fence round the quartiles of its group, by FENCE
times their spread, and beyond the same fence of its language. Quartiles of a group of n rows are its own, weighing n, and those of its
language, weighing PRIOR, averaged; a language leans on all documents likewise. So small groups follow what is wider, and no count
changes the rule. The thresholds are joined to the documents and both verdicts together decide.

Ratios: mean word length, symbols per word, share of lines that repeat, share of words in repeated 3-word windows.

Cases: null text has no words and fails the base rule. A null language or source is a group of its own. Ties and repeated rows get
equal verdicts. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, mixed, per_row, row_key, small, word_hashes

EPS = 0.02
GAMMA = (1 + EPS) / (1 - EPS)
FENCE = 6.0
#: Rows that the wider group counts for in a group's quartiles.
PRIOR = 50
MIN_WORDS, MAX_REPEATED = 50, 50
#: Values at or under this are one bucket.
FLOOR = 1e-4
RATIOS = ("word_length", "symbols", "dup_lines", "repeated")
#: Least spread of the fence, in the ratio's unit: groups of nearly equal values get no narrow fence.
#: A line or two that repeat in a short text are no fault.
LEAST_SPREAD = {"word_length": 0.25, "symbols": 0.02, "dup_lines": 0.1, "repeated": 0.05}
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
_SPACE = " \t\n\x0b\x0c\r"
_NO_SPACE = str.maketrans("", "", _SPACE)
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def measure(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    n = len(words)
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    repeated = 0
    if n >= 4:
        h = word_hashes(words)
        w = mixed(h[:-2], h[1:-1], h[2:])
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            inside = np.zeros(n, bool)
            for k in range(3):
                inside[k : n - 2 + k] |= twice
            repeated = int(inside.sum())
    return n, len(text.translate(_NO_SPACE)), len(text) - len(text.translate(_SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def metrics(docs: DataFrame) -> DataFrame:
    """The row key, doc_id, lang, source and the metrics of every row."""
    keyed = docs.select("doc_id", "lang", "source", *row_key(), "text")
    return per_row(keyed, ["__k1", "__k2", "doc_id", "lang", "source"], "text", METRICS, lambda: measure)


def _ratio(name: str):
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {"word_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / words, "dup_lines": F.col("n_dup_lines") / lines, "repeated": F.col("n_repeat_words") / words}[name]


def sketch(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, bucket, n): one quantile sketch for each group and ratio, of all rows with words."""
    stacked = measured.where("n_words > 0").select(*keys, F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), _ratio(r).alias("v")) for r in RATIOS])).alias("x"))
    bucket = F.when(F.col("x.v") <= FLOOR, 0).otherwise(1 + F.ceil(F.log(F.col("x.v") / FLOOR) / math.log(GAMMA))).cast("int")
    return stacked.groupBy(*keys, F.col("x.ratio").alias("ratio"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, n, a, b): rows, lower and upper quartile of each sketch."""
    by = [*keys, "ratio"]
    upto = F.sum("n").over(W.partitionBy(*by).orderBy("bucket"))
    total = F.sum("n").over(W.partitionBy(*by))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(FLOOR * F.pow(F.lit(GAMMA), F.col("bucket") - 0.5))
    ranked = sketches.select(*by, upto.alias("upto"), total.alias("total"), value.alias("v"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), F.col("v")))
    return ranked.groupBy(*by).agg(F.first("total").alias("n"), quartile(0.25).alias("a"), quartile(0.75).alias("b"))


def leaning(own: DataFrame, wider: DataFrame, keys: list[str]) -> DataFrame:
    """own's quartiles, averaged with those of the wider groups (by keys), which weigh PRIOR rows."""
    other = wider.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("ratio").alias("r"), F.col("a").alias("wa"), F.col("b").alias("wb"))
    same = [F.col("ratio") == F.col("r"), *(F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys)]
    mean = lambda x, w: ((F.col("n") * F.col(x) + PRIOR * F.col(w)) / (F.col("n") + PRIOR)).alias(x)
    rest = [c for c in own.columns if c not in ("a", "b")]
    return own.join(small(other), same).select(*rest, mean("a", "wa"), mean("b", "wb"))


def fences(quartered: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """(keys, {prefix}: map from ratio to (low, high)) of all groups."""
    least = F.create_map(*[F.lit(x) for r in RATIOS for x in (r, LEAST_SPREAD[r])])[F.col("ratio")]
    spread = F.greatest(F.col("b") - F.col("a"), least) * FENCE
    made = quartered.select(*keys, "ratio", F.struct((F.col("a") - spread).alias("low"), (F.col("b") + spread).alias("high")).alias("f"))
    return made.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ratio", "f"))).alias(prefix))


def judge(measured: DataFrame) -> DataFrame:
    """measured (materialized) with base_failed and kept."""
    fine = materialize(sketch(measured, ["lang", "source"]), "sketch")
    every = quartiles(merge(fine, []), [])  # one row for each ratio
    by_lang = materialize(leaning(quartiles(merge(fine, ["lang"]), ["lang"]), every, []), "quartiles")
    by_source = leaning(quartiles(fine, ["lang", "source"]), by_lang, ["lang"])
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    out = measured
    for quartered, keys, name in ((by_source, ["lang", "source"], "own"), (by_lang, ["lang"], "wide")):
        table = materialize(fences(quartered, keys, name), name)
        other = table.select(*(F.col(k).alias(f"__{k}") for k in keys), name)
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        out = out.join(small(other), same, "left").drop(*(f"__{k}" for k in keys))
    failed = F.lit(False)
    for r in RATIOS:
        beyond = lambda name: (_ratio(r) < F.col(name)[r]["low"]) | (_ratio(r) > F.col(name)[r]["high"])  # noqa: B023, E731
        failed = failed | F.coalesce(beyond("own") & beyond("wide"), F.lit(False))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & ~failed).drop("own", "wide")


def quality(docs: DataFrame) -> DataFrame:
    """The row key, doc_id, lang, source, the metrics, base_failed and kept of every row."""
    return judge(materialize(metrics(docs), "metrics"))


def query(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")

"""Ranked lexical search by scanning documents with an automaton of all item terms.

The terms of a block of items go into one Aho-Corasick automaton with a boundary mark on both sides, so that only whole words match.
It is broadcast as its sorted terms; every task builds it once and counts term frequencies straight from the texts: there is no index
of documents, no posting is written and no text is shuffled. The first scan adds up document frequencies and the two corpus sums, the
second turns each document's counts into scores of all items at once (an automaton output leads to the items that hold the term) and
keeps the best documents of each item within its task. The lists of the tasks are then cut in two steps, by item and share, by item.

Items are taken from the driver's iterator in blocks of at most BLOCK_ITEMS items and BLOCK_BYTES of text, whatever their number; the
documents are scanned twice for each block.

Cases: null texts, and texts without a term, match nothing and count nowhere. Equal scores rank by ascending doc_id, a null doc_id last.
Repeated documents each take a place; every row of the item table is an item of its own, also if it repeats another. Items without
terms, and terms that no document has, give no rows; empty tables give an empty result. A long text is one string, scanned in one go.
Other columns play no part. doc_id is an integer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import give_back, materialize, slices, summed, table

TOP = 10
#: A block of items: what is broadcast, and what a task's tables of terms and items are made for.
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 4 << 20
#: Documents whose counts are turned into scores together; their scores are one table of documents by items.
ROWS = 128
#: Terms whose document frequencies travel as one row.
CHUNK = 4096
SHARES = 64
#: Byte by byte: what no term holds becomes a blank, A-Z become a-z. Bytes beyond ASCII belong to terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str) -> bytes:
    """The text's terms in UTF-8, with at least one blank before, between and behind them."""
    return b" %b " % text.encode().translate(_FOLD)


@lru_cache(maxsize=2)
def automaton(terms: tuple[bytes, ...]) -> ahocorasick.Automaton:
    """Finds every term that stands between blanks, and gives its number."""
    out = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        out.add_word(f" {term.decode('latin-1')} ", i)
    if terms:
        out.make_automaton()
    return out


def scan(found: ahocorasick.Automaton, text: str | None) -> tuple[int, Counter]:
    """How many terms the text has, and the frequencies of those in the automaton."""
    if not text:
        return 0, Counter()
    plain = folded(text)
    inside = np.frombuffer(plain, np.uint8) != 32
    n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    return n, Counter(map(itemgetter(1), found.iter(plain.decode("latin-1")))) if n else Counter()


class Best:
    """The k best (score, doc_id) of each item so far, in bounded memory."""

    def __init__(self, items: int, k: int):
        self.items, self.k, self.held = items, k, 0
        self.floor = np.zeros(items, np.int64)  # the k-th best score, once there are k
        self.last = np.full(items, np.iinfo(np.int64).max)  # and the id that has it
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        may = (score > self.floor[item]) | ((score == self.floor[item]) & (score > 0) & (doc <= self.last[item]))
        if may.any():
            self.parts.append((item[may], score[may], doc[may], null[may]))
            self.held += int(may.sum())
            if self.held > max(1 << 18, 4 * self.k * self.items):
                self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, bool))
        item, score, doc, null = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((doc, null, -score, item))
        first = np.searchsorted(item[order], np.arange(self.items))
        rank = np.arange(len(order)) - first[item[order]]
        best = tuple(x[order][rank < self.k] for x in (item, score, doc, null))
        full = order[rank == self.k - 1]
        self.floor[item[full]] = score[full]
        self.last[item[full]] = np.where(null[full], np.iinfo(np.int64).max, doc[full])
        self.parts, self.held = [best], len(best[0])
        return best


def blocks(items: DataFrame) -> Iterator[list]:
    """Rows of (item_id, text) in blocks of bounded size; the driver holds one of them and one partition."""
    block, size = [], 0
    for row in items.toLocalIterator():
        more = len((row[1] or "").encode())
        if block and (len(block) >= BLOCK_ITEMS or size + more > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        yield block


def statistics(docs: DataFrame, shared, size: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all their terms, and each listed term's document frequency."""

    def count(batches):
        found, df, n_docs, length = automaton(shared.value), np.zeros(size, np.int64), 0, 0
        for batch in slices(batches, ROWS):
            for text in batch.column(0).to_pylist():
                n, tf = scan(found, text)
                n_docs += n > 0
                length += n
                df[list(tf)] += 1
        parts = [np.array([n_docs, length]), *(df[i : i + CHUNK] for i in range(0, size, CHUNK))]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["k", "v"])
        give_back()

    rows = sorted(summed(docs.select("text").mapInArrow(count, "k int, v binary")).collect())
    if not rows:
        return 0, 0, np.zeros(size, np.int64)
    (n_docs, length), *df = (np.frombuffer(r[1], np.int64) for r in rows)
    return int(n_docs), int(length), np.concatenate(df)


def ranked_block(docs: DataFrame, rows: list, k: int) -> DataFrame | None:
    """(no, doc_id, score): the k best documents for each row of the block, by its number there; None if nothing can match."""
    spark = docs.sparkSession
    words = [set(folded(text or "").split()) for _, text in rows]
    terms = tuple(sorted(set().union(*words)))
    shared = spark.sparkContext.broadcast(terms)
    n_docs, length, df = statistics(docs, shared, len(terms)) if terms else (0, 0, None)
    if not length:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    # Term to items, as one list with a start for each term.
    number = {t: i for i, t in enumerate(terms)}
    pairs = np.array([(number[w], i) for i, ws in enumerate(words) for w in ws], np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    starts = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
    tables = spark.sparkContext.broadcast((weight, starts, pairs[:, 1]))
    n_items = len(rows)

    def score(batches):
        found, (weight, starts, holders), best = automaton(shared.value), tables.value, Best(n_items, k)
        for batch in slices(batches, ROWS):
            ids, tfs, at, m = [], [], [], []
            for d, text in enumerate(batch.column(1).to_pylist()):
                n, tf = scan(found, text)
                ids += tf.keys()
                tfs += tf.values()
                at += [d] * len(tf)
                m.append(10 + 90 * n * n_docs // length)
            if not ids:
                continue
            ids, tf, at = np.array(ids), np.array(tfs, np.int64), np.array(at)
            gain = weight[ids] * (1_000_000_000 * tf // (1000 * tf + 8 * np.array(m, np.int64)[at]))
            holds = starts[ids + 1] - starts[ids]
            # Places in the list of holders: for each term of each document its run.
            run = np.arange(holds.sum()) - np.repeat(np.cumsum(holds) - holds, holds)
            cell = np.repeat(at, holds) * n_items + holders[np.repeat(starts[ids], holds) + run]
            scores = np.zeros(batch.num_rows * n_items, np.int64)
            np.add.at(scores, cell, np.repeat(gain, holds))
            hit = np.flatnonzero(scores)
            doc, item = hit // n_items, hit % n_items
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            known = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            best.add(item, scores[hit], known[doc], null[doc])
        item, points, doc, null = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=null), pa.array(points, pa.int64())], ["no", "doc_id", "score"])
        give_back()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "no int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("share", F.spark_partition_id() % SHARES)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("no", "share").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(W.partitionBy("no").orderBy(*order))).where(F.col("rank") <= k).select("no", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents that score highest for each item, above 0."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
    key = StructType([StructField("no", IntegerType()), items.schema["item_id"]])
    out = None
    for rows in blocks(items):
        best = ranked_block(docs, rows, k)
        if best is not None:
            if out is not None or len(rows) >= BLOCK_ITEMS:
                best = materialize(best, "ranked")
            names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], key)
            named = best.join(F.broadcast(names), "no").select("item_id", "rank", "doc_id", "score")
            out = named if out is None else out.union(named)
    return spark.createDataFrame([], StructType([key["item_id"], *StructType.fromDDL("rank int, doc_id long, score long").fields])) if out is None else out


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_TERMS} AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
t AS (SELECT doc_id, len(w) AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM d) SEMI JOIN i USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, c GROUP BY term, n_docs),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // length))))::BIGINT AS score FROM i JOIN t USING (term) JOIN f USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {TOP}"""

"""Language ID: multinomial naive Bayes over hashed character n-grams.

Spark counts hashed n-grams of each label; the matrix of log probabilities (buckets x labels) is broadcast, and each batch of texts is
scored as a sparse matrix in numpy: the bucket of every n-gram with row limits, gathered and summed by row. Every label is learned.
The matrix has at most CELLS numbers: with more than CELLS / BUCKETS = 512 labels the buckets are halved as often as it takes.

The n-grams of a text are all runs of 1, 2 and 3 characters of its lower case. Long texts are scored in pieces that overlap by two
characters, so that every n-gram counts once; the pieces' log probabilities add up.

Cases: null or letterless text: `und`, score 0. Null labels are not learned. Ties go to the label that sorts first. Repeated rows
get the same answer, whatever stands beside them. No labelled rows at all: every text is `und`. Other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import SALTS, materialize, slices, small

#: Lengths of the n-grams; each has its own seed, all share the buckets.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Numbers in the broadcast matrix (4 bytes each).
CELLS = 1 << 24
#: The classifier is fitted on at most about so many rows of each label, drawn by a hash of the id.
MAX_ROWS_PER_LABEL = 20_000
ALPHA = 0.5
PIECE = 200_000
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    labels: list[str]
    logp: np.ndarray  # float32, (buckets + 1) x labels; the last row is zero
    prior: np.ndarray


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def _packed(texts: list[tuple[int, str]], piece: int = PIECE):
    """Batches of bounded size: row and code points of each piece, and how many of its n-grams' starts are its own."""
    rows, parts, own, size = [], [], [], 0
    for row, text in texts:
        codes = _codes(text)
        for at in range(0, len(codes), piece):
            part = codes[at : at + piece + max(ORDERS) - 1]
            rows.append(row)
            parts.append(part)
            own.append(min(piece, len(codes) - at))
            size += len(part)
            if size >= piece:
                yield rows, parts, own
                rows, parts, own, size = [], [], [], 0
    if rows:
        yield rows, parts, own


def _buckets(parts: list[np.ndarray], own: list[int], buckets: int):
    """Where each piece starts, and for each order the bucket of the n-gram at every position; `buckets` where none of the piece's own starts."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    c = np.concatenate(parts)
    n = len(c)
    h = np.full(n, 2166136261, np.uint32)
    shift = np.uint32(32 - int(np.log2(buckets)))
    place = np.arange(n) - np.repeat(starts, sizes)
    out = []
    for k in range(max(ORDERS)):
        h = (h[: n - k] ^ c[k:]) * np.uint32(16777619)
        if k + 1 in ORDERS:
            b = h ^ (h >> np.uint32(15))
            b = ((b * np.uint32(0x2C1B3C6D + 2 * k)) >> shift).astype(np.int64)
            out.append(np.where(place[: len(b)] < np.repeat(np.minimum(own, sizes - k), sizes)[: len(b)], b, buckets))
    return starts, out


def fit(rows: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", buckets: int = BUCKETS, max_rows: int = MAX_ROWS_PER_LABEL) -> Model:
    """Learn from the labelled rows. Only their texts and labels count; doc_id only draws the bounded sample."""
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"), F.col(doc_id).alias("i"))
    shares = materialize(rows.groupBy("l").agg(F.count("*").alias("n")), "labels")
    found = {r["l"]: r["n"] for r in shares.collect()}  # one row for each label
    labels = sorted(found)
    while buckets > 64 and buckets * len(labels) > CELLS:
        buckets >>= 1
    if not labels:
        return Model([], np.zeros((buckets + 1, 0), np.float32), np.zeros(0))
    draw = F.pmod(F.xxhash64("i"), F.lit(1 << 20)) / float(1 << 20)
    drawn = rows.join(small(shares, len(labels)), "l").where(draw < max_rows / F.col("n")).select("t", "l")
    schema = "l string, b binary, n binary"

    def emit(totals: dict[str, np.ndarray]) -> pa.RecordBatch:
        """The buckets that occur, with their counts."""
        some = [(name, np.flatnonzero(total).astype(np.int32), total) for name, total in totals.items()]
        rows = [(name, b.tobytes(), total[b].tobytes()) for name, b, total in some]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["l", "b", "n"])

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            by: dict[str, list] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).append((0, t))
            for name, texts in by.items():
                total = totals.setdefault(name, np.zeros(buckets, np.int64))
                for _, parts, own in _packed(texts):
                    for b in _buckets(parts, own, buckets)[1]:
                        total += np.bincount(b, minlength=buckets + 1)[:buckets]
            if len(totals) * buckets > CELLS:
                yield emit(totals)
                totals = {}
        yield emit(totals)

    def add(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in slices(batches, 64):
            for name, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                totals.setdefault(name, np.zeros(buckets, np.int64))[np.frombuffer(b, np.int32)] += np.frombuffer(n, np.int64)
        yield emit(totals)

    counted = drawn.mapInArrow(count, schema)
    some = counted.withColumn("s", F.spark_partition_id() % SALTS).repartition("l", "s").select("l", "b", "n").mapInArrow(add, schema)
    counts = np.zeros((len(labels), buckets), np.float32)
    place = {name: k for k, name in enumerate(labels)}
    for r in some.repartition("l").mapInArrow(add, schema).toLocalIterator():  # CELLS numbers at most
        counts[place[r["l"]], np.frombuffer(r["b"], np.int32)] = np.frombuffer(r["n"], np.int64)
    logp = np.log((counts + ALPHA) / (counts.sum(1, keepdims=True, dtype=np.float64) + ALPHA * buckets))
    docs = np.array([min(found[x], max_rows) for x in labels], float)
    return Model(labels, np.vstack([logp.T, np.zeros((1, len(labels)))]).astype(np.float32), np.log(docs / docs.sum()))


def posterior(model: Model, texts: list[str | None], piece: int = PIECE) -> tuple[list[str], np.ndarray]:
    """The likeliest label of each text, and its posterior probability."""
    useful = [(i, t) for i, t in enumerate(texts) if t and model.labels and _LETTER.search(t)]
    total = np.tile(model.prior, (len(texts), 1))
    piece = min(piece, max(1024, 4_000_000 // max(len(model.labels), 1)))  # numbers gathered at a time
    for rows, parts, own in _packed(useful, piece):
        starts, found = _buckets(parts, own, len(model.logp) - 1)
        for b in found:
            some = starts < len(b)
            np.add.at(total, np.array(rows)[some], np.add.reduceat(model.logp[b], starts[some], axis=0, dtype=np.float64))
    label, p = ["und"] * len(texts), np.zeros(len(texts))
    for i, _ in useful:
        k = int(np.argmax(total[i]))
        label[i], p[i] = model.labels[k], 1.0 / np.exp(total[i] - total[i, k]).sum()
    return label, p


def predict(df: DataFrame, model: Model, carry: list[Column], text: str = "text", piece: int = PIECE) -> DataFrame:
    """The columns carry, then lang_pred and score (the posterior of that label)."""
    base = df.select(*carry, F.col(text))
    width = len(carry)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in slices(batches):
            label, p = posterior(shared.value, batch.column(width).to_pylist(), piece)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(label, pa.string()), pa.array(p)], [*batch.schema.names[:width], "lang_pred", "score"])

    return base.mapInArrow(score, StructType([*base.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: learn from the documents that are not held out, predict all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string")) % 4
    model = fit(docs.where(part != 2))
    held = F.coalesce(part == 2, F.lit(False)).alias("held_out")
    return predict(docs, model, [F.col("doc_id"), held])

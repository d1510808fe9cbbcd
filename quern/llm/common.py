"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A table is broadcast only if it was counted and has at most so many narrow rows (under 10 MB), or so many rows of a few hundred
#: bytes, or so many bytes that were summed; else Spark shuffles.
BROADCAST_ROWS, BROADCAST_WIDE_ROWS, BROADCAST_BYTES = 200_000, 20_000, 16 << 20
KEY = ["__k1", "__k2"]
#: Bytes of a row group of intermediate tables: what each writing task holds in memory.
ROW_GROUP = 16 << 20
#: Bytes and rows of an Arrow batch on its way to a Python worker: both sides hold whole batches.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2_000
#: Shares into which the rows of one key are dealt before their last sum.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where it is unset, a session in one process gets a new local one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quern-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete what materialize wrote. Only for tables that nothing still to be computed reads."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns of these names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(text: str = "text", doc_id: str = "doc_id", names: list[str] = KEY) -> list[Column]:
    """A 128-bit key of a row's id and text, never null. Rows with equal id and text share it; all results kept under it depend on the text alone."""
    return [F.xxhash64(F.lit(i), F.col(doc_id), F.col(text)).alias(k) for i, k in enumerate(names, 1)]


def small(df: DataFrame, rows: int | None = None, wide: bool = False) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else as it is. Call it on materialized tables."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= (BROADCAST_WIDE_ROWS if wide else BROADCAST_ROWS) else df


def without_rows(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose key (see row_key) is in rejected, a materialized table with the columns KEY. docs may have any other columns."""
    names = fresh(docs, *KEY)
    gone = small(rejected.select(*KEY)).toDF(*names)
    return docs.select("*", *row_key(names=names)).join(gone, names, "left_anti").select(*quoted(docs.columns))


def summed(parts: DataFrame) -> DataFrame:
    """parts(k int, v binary: int64 arrays of one length for each k), one row a task and k, to one row for each k. Added in two levels,
    so that the rows of a key, as many as there are tasks, are not all one task's."""

    def add(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in slices(batches, 64):
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(v, np.int64)
                totals[k] = totals[k] + v if k in totals else v
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["k", "v"])

    some = parts.withColumn("s", F.spark_partition_id() % SALTS).repartition("k", "s").select("k", "v").mapInArrow(add, "k int, v binary")
    return some.repartition("k").mapInArrow(add, "k int, v binary")


def short_batches(spark: SparkSession) -> None:
    """Let Spark send texts to Python workers in batches of a few MB, unless the session says otherwise: by default they have 10 000 rows."""
    for name, usual, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key, None) in (usual, f"{usual}b", "64MB"):
            spark.conf.set(key, str(value))


def give_back() -> None:
    """Return memory that a task no longer needs to the system: Python workers outlive tasks and share their executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def per_row(df: DataFrame, carry: list[str], column: str, schema: str, make: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """One output row for each input row: the columns carry, then what make()'s function gives for the text. make runs once in each task;
    if the function has an attribute close, that is called at the task's end."""
    width, added = len(carry), StructType.fromDDL(schema).fields
    # Plain names on the way, for mapInArrow takes no others.
    base = df.select(*(c.alias(f"c{i}") for i, c in enumerate(quoted([*carry, column]))))

    def run(batches):
        f = make()
        for batch in slices(batches):
            rows = [f(t) for t in batch.column(width).to_pylist()]
            if rows:
                yield [batch.columns[:width], rows]
        getattr(f, "close", int)()
        give_back()

    target = StructType([*base.schema.fields[:-1], *(StructField(f"n{i}", f.dataType) for i, f in enumerate(added))])
    arrow = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in target.fields])

    def arrays(batches):
        for kept, rows in run(batches):
            columns = [pa.array(c, arrow.field(width + i).type) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*kept, *columns], schema=pa.schema([*(pa.field(n, c.type) for n, c in zip(arrow.names, kept)), *list(arrow)[width:]]))

    return base.mapInArrow(arrays, target).toDF(*carry, *(f.name for f in added))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# ---- words and shingles -------------------------------------------------------------------------------------------

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_ONE, _TWO = np.uint64(0x11ED270B9F6C1D35), np.uint64(0x0545F4914F6CDD1D)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(a, b, c) -> np.ndarray:
    """64-bit hashes of ordered triples of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = a * _MIX[0] + b
        h ^= h >> np.uint64(29)
        h = h * _MIX[1] + c
        h ^= h >> np.uint64(32)
        h *= _MIX[2]
        return h ^ (h >> np.uint64(29))


def ngrams(h: np.ndarray, k: int = 3) -> np.ndarray:
    """Hashes of the windows of k words; of the whole sequence if it is shorter; none without words."""
    n = len(h)
    if n < k:
        parts, tag = [h[i : i + 1] for i in range(n)], np.array([_ONE + _TWO * np.uint64(n)]) if n else h
    else:
        parts, tag = [h[i : n - k + 1 + i] for i in range(k)], np.full(n - k + 1, _TWO)
    out = parts[0] if parts else h
    for i in range(1, len(parts), 2):
        out = mixed(out, parts[i], parts[i + 1] if i + 1 < len(parts) else tag)
    return out if n >= k or not n else mixed(out, tag, tag)


def small_bytes(df: DataFrame, column: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the bytes of its wide column, and of 64 for the rest of each row, are within the bound; else as it is."""
    size = df.agg(F.sum(F.octet_length(column) + 64)).first()[0]
    return F.broadcast(df) if (size or 0) <= most else df

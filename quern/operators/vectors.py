"""Vector search through coarse cells.

Cells are the centroids of a bounded sample that is drawn over all rows; every row is then put into its nearest cell, and the table is
written by cell. A search compares a query with the rows of its nearest cells only, which the scan is pruned to; how many are read is
measured on the sample, so that they hold the wanted share of its true neighbours: few where vectors form groups, most where they do not.
With exact=True a query is compared with all rows. Queries are broadcast in blocks, rows are never shuffled, so a cell may hold any share of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import nearest as N
from quern.operators import search as S
from quern.sources.scratch import materialize, new_path

#: Rows that cells are learned from, about; cells, at most, and rounds of learning.
SAMPLE, CELLS, ROUNDS = 50_000, 1024, 8
#: Sampled rows that are asked for their neighbours, how many each, and the share of these that must be found.
ASKED, NEIGHBOURS, WANTED = 500, 10, 0.97
_BITS = 1 << 20


def _units(rows: list) -> np.ndarray:
    v = np.array(rows, np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def learn_cells(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = ROUNDS, wanted: float = WANTED) -> tuple[np.ndarray, int]:
    """Unit centroids of about `sample` rows, which a hash of the id draws from all, and how many cells must be read. As many cells as the root of
    the rows, if not stated."""
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    drawn = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(_BITS)) < int(share * _BITS) + (share == 1.0)).select("embedding")
    v = _units([r[0] for r in drawn.collect()])  # `sample` rows, about, whatever the table holds
    if not len(v):
        return v, 1
    # Rows that are asked do not shape the cells, as later queries will not.
    step = max(2, len(v) // ASKED)
    asked, own = v[::step], np.arange(0, len(v), step)
    rest = np.delete(v, own, axis=0) if len(v) > ASKED else v
    cells = min(cells or max(1, min(CELLS, round(n**0.5))), len(rest))
    centroids = rest[np.random.default_rng(7).choice(len(rest), cells, replace=False)]
    for _ in range(rounds):
        near = (rest @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rest)
        met = np.bincount(near, minlength=cells) > 0
        centroids[met] = _units(sums[met])
    # For each of some rows, how many cells are nearer than those of its nearest neighbours.
    alike = asked @ v.T
    alike[np.arange(len(asked)), own] = -2
    near = np.argsort(-alike, axis=1)[:, :NEIGHBOURS]
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
    reached = np.sort(np.take_along_axis(place, (v @ centroids.T).argmax(1)[near], 1).ravel())
    return centroids, int(reached[min(int(np.ceil(len(reached) * wanted)), len(reached)) - 1]) + 1


def _nearest(df: DataFrame, column: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """df with `cells`, the numbers of the nearest centroids, nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column(at).flatten(), np.float32).reshape(batch.num_rows, -1)
                near = v @ shared.value.T
                order = near.argmax(1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
                order = order.astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, cells array<int>")


class VectorIndex:
    """An index over vectors(vec_id, embedding): vectors of one length, none null."""

    def __init__(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, path: str | None = None, wanted: float = WANTED):
        self.spark, self.path = vectors.sparkSession, path or new_path(vectors.sparkSession, "cells")
        vectors = vectors.select("vec_id", "embedding")
        self.centroids, self.probes = learn_cells(vectors, cells, sample, wanted=wanted)
        self.schema = vectors.schema
        _nearest(vectors, "embedding", self.centroids, 1).withColumn("cell", F.col("cells")[0]).drop("cells").write.partitionBy("cell").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema.simpleString()[7:-1].replace(":", " ") + ", cell int").parquet(self.path)

    def search(self, queries: DataFrame, k: int, least: float = 0.0, probes: int | None = None, exact: bool = False) -> DataFrame:
        """q, vec_id, score, rank: the k nearest of queries(q, v) among the rows of `probes` cells, self.probes if not stated, or among all."""
        probes = probes or self.probes
        if exact or probes >= len(self.centroids):
            return S.vector_search(self.rows().drop("cell"), queries, k, least)
        asked = materialize(queries.where("q is not null").select(F.col("q").cast("long").alias("q"), "v"), "asked")
        compare = N.cosines(k, least, centroids=self.spark.sparkContext.broadcast(self.centroids), probes=probes)
        scored = S.against_all(self.rows().where("vec_id is not null"), asked, compare, "q long, vec_id long, score double")
        return S.top(scored, "q", "score", "vec_id", k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the rows of exact(q, vec_id) that were found."""
    hit = exact.select("q", "vec_id").join(found.select("q", "vec_id", F.lit(1).alias("hit")), ["q", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0

"""Centroid clustering of integer vectors on bit planes.

A vector of 64 integer components is kept as its bit planes in two's complement: plane p holds bit p of every component, packed into
one 64-bit word. A dot product is then a sum over pairs of planes, popcount(plane of the vector AND plane of the centroid) times the
product of their weights, 2^p, or -2^p for the sign plane: exact integers, and so are the squared distances built from them. Planes are
packed once and written; each round reads them, assigns, and adds up components and counts by cluster from the planes themselves. What
comes to the driver in a round is one sum of 64 components for each centroid.

Cases: vectors that are null, that hold a null, NaN or infinity, or that have another number of components are left out. A component x
stands as floor(1024 * x) and must lie within +-2^26, so that distances are 64-bit integers; a vector beyond that ends the job with
an error that says so. Equal distances go to the smaller number, centroids without vectors stay where they are. With fewer vectors than
centroids there are as many centroids as vectors; repeated rows are vectors of their own, and equal start hashes are taken in the order
of their components. A null id is hashed as the text `null`. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, give_back, materialize, slices, table

SIZE = 64
SCALE = 1024
CENTROIDS, ROUNDS = 8, 10
#: Bits of a component, its sign included: squared distances of 64 such components stay below 2^63.
BITS = 27
ROWS = 4096
SHARES = 32


def planes_of(v: np.ndarray, bits: int) -> np.ndarray:
    """Words (rows, bits) of integer vectors (rows, 64): word p holds bit p of every component, component 0 in the lowest bit."""
    out = np.empty((len(v), bits), np.uint64)
    for p in range(bits):
        out[:, p] = np.packbits((v >> p & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def needed(v: np.ndarray) -> int:
    """Bits that hold every component, its sign included."""
    return int(max(v.max(), -v.min() - 1, 0)).bit_length() + 1


def weights(bits: int) -> list[int]:
    return [1 << p for p in range(bits - 1)] + [-(1 << (bits - 1))]


def dots(planes: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Dot products of packed vectors with one packed vector."""
    out = np.zeros(len(planes), np.int64)
    for p, w in enumerate(weights(planes.shape[1])):
        part = np.zeros(len(planes), np.int64)
        for q, u in enumerate(weights(len(centroid))):
            if centroid[q]:
                part += u * np.bitwise_count(planes[:, p] & centroid[q]).astype(np.int64)
        out += w * part
    return out


def component_sums(planes: np.ndarray) -> np.ndarray:
    """The sum of packed vectors, component by component."""
    out = np.zeros(SIZE, np.int64)
    for p, w in enumerate(weights(planes.shape[1])):
        out += w * np.unpackbits(planes[:, p].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def nearest(planes: np.ndarray, norms: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smaller one on ties, and the squared distance to it."""
    c = np.array(centroids, np.int64)
    best = np.stack([norms - 2 * dots(planes, p) + int((x * x).sum()) for x, p in zip(c, planes_of(c, needed(c)))], 1)
    cluster = best.argmin(1)
    return cluster, best[np.arange(len(best)), cluster]


def packed(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, bits, planes binary, norm) of the vectors that are kept."""
    scaled = F.transform(embedding, lambda x: F.floor(SCALE * x.cast("double")))
    kept = vectors.where(
        (F.size(embedding) == SIZE) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    )
    inside = F.forall(embedding, lambda x: F.abs(x.cast("double") * SCALE) < float(1 << (BITS - 1)))
    whole = F.when(inside, scaled).otherwise(F.raise_error(F.lit("a component is too large for 64-bit distances")))
    rows = kept.select(F.col(vec_id).alias("vec_id"), whole.cast("array<bigint>").alias("v"))

    def pack(batches):
        for batch in slices(batches, ROWS):
            v = np.asarray(batch.column(1).flatten(), np.int64).reshape(-1, SIZE)
            bits = needed(v)
            planes = planes_of(v, bits)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([bits] * n, pa.int32()), pa.array([p.tobytes() for p in planes], pa.binary()), pa.array((v * v).sum(1), pa.int64())], ["vec_id", "bits", "planes", "norm"]
            )
        give_back()

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(pack, f"vec_id {kind}, bits int, planes binary, norm long")


def unpacked(batches):
    """(batch, planes, norms) of short slices of a packed table in which all rows of a slice have equally many planes."""
    for batch in slices(batches, ROWS):
        bits = batch.column("bits").to_numpy(zero_copy_only=False)
        for b in np.unique(bits):
            part = batch.filter(pa.array(bits == b)) if len(np.unique(bits)) > 1 else batch
            planes = np.frombuffer(b"".join(part.column("planes").to_pylist()), np.uint64).reshape(-1, b)
            yield part, planes, part.column("norm").to_numpy()


def starting(vectors: DataFrame, k: int) -> list[list[int]]:
    """The k packed vectors with the smallest hashes, in that order, as integers."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = vectors.select(key.alias("h"), "bits", "planes").orderBy("h", "bits", "planes").limit(k).collect()
    planes = [np.frombuffer(r["planes"], np.uint64).reshape(1, -1) for r in rows]
    return [component_sums(p).tolist() for p in planes]


def moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid at the floor of its vectors' mean; those without vectors stay."""

    def assign(batches):
        sums = np.zeros((len(centroids), SIZE + 1), np.int64)
        for _, planes, norms in unpacked(batches):
            cluster, _ = nearest(planes, norms, centroids)
            for c in np.unique(cluster):
                own = planes[cluster == c]
                sums[c, :SIZE] += component_sums(own)
                sums[c, SIZE] += len(own)
        met = np.flatnonzero(sums[:, SIZE])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), *(pa.array(sums[met, i]) for i in range(SIZE + 1))], ["cluster", *names])
        give_back()

    names = [f"s{i}" for i in range(SIZE)] + ["n"]
    parts = vectors.select("bits", "planes", "norm").mapInArrow(assign, "cluster int, " + ", ".join(f"{n} long" for n in names))
    total = [F.sum(n).alias(n) for n in names]
    some = parts.groupBy("cluster", (F.spark_partition_id() % SHARES).alias("share")).agg(*total)
    out = list(centroids)
    for row in some.groupBy("cluster").agg(*total).collect():
        out[row["cluster"]] = [row[n] // row["n"] for n in names[:SIZE]]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid array<long>) of every vector that is kept."""
    kept = materialize(packed(vectors, vec_id, embedding), "planes")
    centroids = starting(kept, k)
    for _ in range(rounds if centroids else 0):
        after = moved(kept, centroids)
        if after == centroids:
            break  # every further round would repeat this one
        centroids = after

    def assign(batches):
        for part, planes, norms in unpacked(batches):
            c, distance = nearest(planes, norms, centroids)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(c, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])
        give_back()

    kind = kept.schema["vec_id"].dataType.simpleString()
    assigned = materialize(kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), "assigned")
    discard(kept)
    inertia = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}
    spark = vectors.sparkSession
    rows = [(c, inertia[c], sum(inertia.values()), centroids[c]) for c in sorted(inertia)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<bigint>")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def query(spark, sf_dir: str) -> DataFrame:
    out = cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql() -> str:
    """The rounds written out, one after another; vectors are lists of integers."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings "
        f"WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h) - 1)::INTEGER AS c, x FROM (SELECT x, sha256('3:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {CENTROIDS}))",
    ]
    for r in range(ROUNDS + 1):
        distance = "list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v.x, k.c, {distance} AS d FROM v, c{r} k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k.c) = 1)")
        if r < ROUNDS:
            mean = "(sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*)"
            steps.append(
                f"m{r} AS (SELECT c, list(e ORDER BY i) AS x FROM (SELECT c, i, ({mean})::BIGINT AS e FROM (SELECT c, unnest(range({SIZE})) AS i, unnest(x) AS e FROM a{r}) GROUP BY c, i) GROUP BY c)"
            )
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m{r}.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} ON m{r}.c = o.c)")
    return f"""WITH {', '.join(steps)}
SELECT vec_id, a.c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
 sha256(array_to_string(k.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} k ON k.c = a.c"""


ORACLE_SQL = _sql()

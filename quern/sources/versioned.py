"""A table of versions that micro-batches merge into, rewriting only the buckets they touch.

Rows are dealt to a fixed number of buckets by a hash of some key columns. A version is one small manifest that names, for every bucket,
the folder that holds its rows; folders are never changed once written. A merge reads the touched buckets of the newest version, takes
out rows whose keys come again, writes these buckets into a new folder, and puts the next manifest in place by one rename, which
fails if the version exists. Readers see whole versions only; a merge that dies leaves files that no manifest names.

How much a batch rewrites depends on how its keys lie in the buckets: `by` should be the columns along which changes come together (a
repository, a folder), and buckets should be many times the number of those that a batch touches.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], by: list[str] | None = None, buckets: int = 256):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.by = by or keys
        if not set(self.by) <= set(keys):
            raise ValueError("the columns that choose a bucket must belong to the key")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    # ---- versions

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """number, batch, and the folder of every bucket that has rows."""
        known = self.versions()
        if not known:
            return {"number": -1, "batch": None, "folders": {}}
        stream = self._fs.open(self._path("manifests", f"{known[-1] if version is None else version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        hidden = self._path("manifests", f".{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        final = self._path("manifests", f"{manifest['number']:012d}.json")
        if self._fs.exists(final) or not self._fs.rename(hidden, final):
            self._fs.delete(hidden, False)
            raise RuntimeError(f"version {manifest['number']} was written by another job")

    # ---- reading and merging

    def _folders(self, manifest: dict, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{folder}/__bucket={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]

    def _rows(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self._folders(self.manifest(version)))

    def merge(self, rows: DataFrame, batch: int | None = None, gone: DataFrame | None = None) -> int:
        """Rows whose keys occur in `rows` or `gone` make way for `rows` (several rows of one key come and go together). A batch number that was
        merged before changes nothing. Returns the version's number. rows is read twice."""
        before = self.manifest()
        if batch is not None and before["batch"] is not None and batch <= before["batch"]:
            return before["number"]
        rows = rows.select(*self.schema.names)
        keys = rows.select(*self.keys)
        keys = (keys if gone is None else keys.union(gone.select(*self.keys))).distinct()
        touched = sorted(r[0] for r in keys.select(self.bucket().alias("b")).distinct().collect())  # as many as there are buckets, at most
        if not touched:
            return before["number"]
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        kept = self._rows(self._folders(before, touched)).alias("o").join(keys.alias("n"), same, "left_anti")
        folder = f"{before['number'] + 1:012d}-{uuid.uuid4().hex}"
        merged = kept.union(rows).withColumn("__bucket", self.bucket())
        # Buckets are dealt out whole where they are small, and in parts where they are large.
        merged.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/data/{folder}")
        target = self._path("data", folder)
        held = {s.getPath().getName().removeprefix("__bucket=") for s in self._fs.listStatus(target) if s.getPath().getName().startswith("__bucket=")}
        folders = {b: f for b, f in before["folders"].items() if int(b) not in touched} | {b: folder for b in held}
        self._publish({"number": before["number"] + 1, "batch": before["batch"] if batch is None else batch, "folders": folders})
        return before["number"] + 1

    def vacuum(self, keep: int = 2) -> None:
        """Delete all but the newest versions, and folders that none of these names. Not beside a running merge."""
        known = self.versions()
        for number in known[:-keep]:
            self._fs.delete(self._path("manifests", f"{number:012d}.json"), False)
        named = {f"{f}/__bucket={b}" for n in known[-keep:] for b, f in self.manifest(n)["folders"].items()}
        for version in self._fs.listStatus(self._path("data")):
            inside = [s.getPath() for s in self._fs.listStatus(version.getPath()) if s.getPath().getName().startswith("__bucket=")]
            unused = [p for p in inside if f"{p.getParent().getName()}/{p.getName()}" not in named]
            for p in [version.getPath()] if len(unused) == len(inside) else unused:
                self._fs.delete(p, True)

    def bytes_of(self, version: int) -> int:
        """Bytes that a version's own merge wrote."""
        return sum(s.getLen() for f in self._fs.listStatus(self._path("data")) if f.getPath().getName().startswith(f"{version:012d}-") for b in self._fs.listStatus(f.getPath()) if b.isDirectory() for s in self._fs.listStatus(b.getPath()))

"""The table of versions: merges, reruns, what a merge writes, and the stream that feeds it."""

import pytest
from pyspark.sql import functions as F

from quern.sources import derived as D
from quern.sources.versioned import VersionedTable
from quern.streaming import jobs

SF = "/root/testdata/sf0.01"


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merges_and_versions(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "file string, chunk int, text string")
    table = VersionedTable(spark, str(tmp_path / "t"), make([]).schema, ["file"], buckets=8)
    assert held(table.read()) == [] and table.merge(make([]), 0) == -1
    assert table.merge(make([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "x"), (None, 0, "n")]), 1) == 0
    # A file comes again with fewer chunks: its old ones are gone; a null key is a key.
    assert table.merge(make([("a", 0, "new"), (None, 0, "m")]), 2) == 1
    after = [("a", 0, "new"), ("b", 0, "x"), (None, 0, "m")]
    assert held(table.read()) == sorted(after, key=repr)
    # The same batch again, and an older one, change nothing.
    assert table.merge(make([("a", 0, "other")]), 2) == 1 and table.merge(make([("b", 0, "other")]), 1) == 1
    assert held(table.read()) == sorted(after, key=repr)
    # Deleting without new rows; earlier versions stay readable until vacuum.
    assert table.merge(make([]), 3, gone=make([("b", 9, "")]).select("file")) == 2
    assert held(table.read()) == sorted([after[0], after[2]], key=repr) and len(held(table.read(0))) == 5
    table.vacuum(keep=1)
    assert table.versions() == [2] and held(table.read()) == sorted([after[0], after[2]], key=repr)


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x")], "k long, v string")
    one, two = (VersionedTable(spark, str(tmp_path / "t"), rows.schema, ["k"], buckets=4) for _ in range(2))
    stale = two.manifest()
    one.merge(rows, 0)
    with pytest.raises(RuntimeError, match="another job"):
        two._publish(stale | {"number": 0})
    assert held(two.read()) == [(1, "x")]


def test_a_small_batch_rewrites_little(spark, tmp_path):
    docs = D.table(spark, SF, "documents").select("doc_id", "text", "source")
    table = VersionedTable(spark, str(tmp_path / "t"), docs.schema, ["doc_id"], buckets=512)
    table.merge(docs, 0)
    hundredth = docs.where("doc_id % 100 = 7").withColumn("text", F.concat("text", F.lit("!")))
    table.merge(hundredth, 1)
    assert table.bytes_of(1) < 0.05 * table.bytes_of(0)
    assert table.read().where("text like '%!'").count() >= hundredth.count() and table.read().count() == docs.count()


def test_stream(spark, tmp_path):
    docs = D.table(spark, SF, "documents").select("doc_id", "source")
    source = str(tmp_path / "in")
    table = VersionedTable(spark, str(tmp_path / "table"), docs.schema, ["doc_id"], buckets=16)
    for part in (0, 1, 1):  # the third time nothing new has landed
        if part == 0 or len(table.versions()) == 1:
            docs.where(F.col("doc_id") % 3 >= part).withColumn("source", F.concat("source", F.lit(f"+{part}"))).write.mode("append").parquet(source)
        jobs.incremental_index(spark.readStream.schema(docs.schema).parquet(source), table, str(tmp_path / "checkpoint")).awaitTermination()
    assert table.versions() == [0, 1] and table.read().count() == docs.count()
    assert table.read().where((F.col("doc_id") % 3 >= 1) != F.col("source").endswith("+1")).count() == 0
    # A new checkpoint begins its numbers again: batches that the table has seen change nothing.
    jobs.incremental_index(spark.readStream.schema(docs.schema).parquet(source), table, str(tmp_path / "again")).awaitTermination()
    assert table.versions() == [0, 1]

"""Every registered query of the library against its SQL on the smallest tables; queries without SQL must give rows."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb
import pytest

from quern.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    expected = db.sql(sql)
    assert sorted(df.columns) == sorted(expected.columns)
    got = Counter(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
    columns = ", ".join(f'"{c}"' for c in sorted(expected.columns))
    assert got == Counter(map(repr, db.sql(f"SELECT {columns} FROM ({sql})").fetchall()))


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["item_id", "chunk", "score", "rank", "highlights"]
    assert out.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

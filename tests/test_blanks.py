"""Blanks, line ends and edges of words as in SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans import search_queries, text_queries

TEXTS = [None, "", "  !", "a" * 140 + " tail\nmore", "a" * 130 + " b\x0bc\n" + "d" * 30, "a" * 130 + " end\r \n" + "x" * 40, " leading blank here　. next", "élonglonglonglongwordsx", "x.mdé", "a\x0bb"]


@pytest.mark.parametrize("name, table, sql", [("c21_make_snippet", "documents", text_queries.SQL), ("f28_query_advice", "conversations", search_queries.SQL)])
def test_odd_texts_as_in_sql(spark, tmp_path, name, table, sql):
    queries = text_queries.QUERIES | search_queries.QUERIES
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(0), "role": F.lit("user")})
    df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        assert sorted(map(tuple, queries[name](spark, str(tmp_path)).collect()), key=str) == sorted(c.sql(sql[name]).fetchall(), key=str)


def test_blanks_of_unicode(spark):
    assert spark.range(1).select(T.without_blanks(F.lit("  a b　"))).first()[0] == "a b"

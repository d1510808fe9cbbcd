"""What is computed row by row over chunk tables: shared ends, keywords, stems."""

from pyspark.sql import functions as F

from quern.operators import chunking as C


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shared_ends_of_neighbours(spark):
    texts = ["x" * 300 + "tail of one", "tail of one" + "y" * 10, "y" * 150, "y" * 400, "", "none"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "doc_id long, chunk_index long, content string")
    got = C.adjacent_repeat(df)
    assert [tuple(r) for r in got.orderBy("chunk_index").select("shared", "dropped").collect()] == [(11, 0), (10, 0), (150, 150), (0, 0), (0, 0)]
    assert "content" not in plan(got).split("Exchange")[0]  # only the ends are shuffled


def test_keywords_by_number_and_first_place_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, "Zeta beta zeta alpha BETA that that that gamma abc"), (2, ""), (3, None)], "k long, t string")
    got = C.top_keywords(df, ["k"], "t", 3)
    assert [tuple(r) for r in got.orderBy("k", "rank").collect()] == [(1, 1, "zeta", 2), (1, 2, "beta", 2), (1, 3, "alpha", 1)]
    assert "Exchange" not in plan(got)
    assert [r[0] for r in df.select(F.array_join(F.transform(C.keywords("t"), lambda x: x["word"]), ",")).collect()] == ["zeta,beta,alpha,gamma", "", ""]


def test_elements_carry_their_text(spark):
    text = "# One\n\ntext\nmore\n\n- a\n- b\n```\ncode\n\nx\n```\n> q\n"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, t string")
    got = C.elements(df, "t", True).orderBy("doc_id", "element").collect()
    assert [r["body"] for r in got] == [text[r["start"] : r["stop"]] for r in got] and len(got) == 5
    assert "Join" not in plan(C.structural(df, "t"))


def test_stems_are_made_without_a_shuffle(spark):
    from quern.functions import stem

    df = spark.createDataFrame([(1, ["hopping", "hoped", "naïves"]), (2, []), (3, None)], "k long, w array<string>")
    got = df.select("k", stem.stems(F.col("w")).alias("s"))
    assert [r["s"] for r in got.orderBy("k").collect()] == [["hop", "hope", "naïves"], [], None]
    terms = stem.stemmed(spark.createDataFrame([(1, "hopping"), (2, None)], "k long, term string"))
    assert [tuple(r) for r in terms.collect()] == [(1, "hopping", "hop")] and "Exchange" not in plan(terms)

"""Content kinds, the choice of a strategy, and the way from documents to chunks."""

from pyspark.sql import functions as F

from quern.operators import chunking as C


def test_kinds_and_strategies(spark):
    rows = [
        ("# Title\n\ntext", None, "markdown", "hybrid"), ("plain words", "a/b.MD", "markdown", "hybrid"), ("plain words", "b.rst", "structured_text", "hybrid"), ("plain words", "c.py", "code", "structural"),
        ("def run():\n    import x", "x.txt", "code", "structural"), ("a { b } c", None, "code", "structural"), ("one\n\ntwo\n\nthree", None, "structured_text", "hybrid"),
        ("- item\nclass act " + "word " * 60, None, "mixed", "hybrid"), ("nothing special " * 20, "z.unknown", "text", "hybrid"), ("word " * 600, None, "text", "semantic"), ("```\nx\n``` " + "y " * 80, None, "text", "structural"),
    ]
    df = spark.createDataFrame([(i, t, p) for i, (t, p, _, _) in enumerate(rows)], "doc_id long, text string, path string")
    got = df.select("doc_id", C.content_kind("text", F.col("path")).alias("k"), C.chosen_strategy("text", F.col("path")).alias("s")).collect()
    assert {r["doc_id"]: (r["k"], r["s"]) for r in got} == {i: (k, s) for i, (_, _, k, s) in enumerate(rows)}


def test_documents_to_chunks(spark):
    markdown = "# Guide\n\n" + "\n\n".join(f"## Part {k}\n\n" + f"Sentence {k} says something of use. " * 30 for k in range(4))
    code = "import os\nclass A { }\n\n" + "\n\n".join(f"def f{k}():\n    return {k}" + "  # filler" * 40 for k in range(5))
    long = " ".join(f"Word{k} is here." for k in range(700))
    texts = {1: markdown, 2: code, 3: long, 4: "short text", 5: "   \n", 6: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {}
    for r in C.document_chunks(df, "text").orderBy("doc_id", "chunk_index").collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert {k: {r["strategy"] for r in v} for k, v in out.items()} == {1: {"hybrid"}, 2: {"structural"}, 3: {"semantic"}, 4: {"hybrid"}}
    for doc, rows in out.items():
        plain = [r["content"] for r in C.merge_short(C.chunk(df.where(F.col("doc_id") == doc), "text", rows[0]["strategy"]).select("doc_id", "chunk_index", "content")).orderBy("chunk_index").collect()]
        assert [r["content"] for r in rows] == list(dict.fromkeys(plain)), doc
        # No text is lost but repeated chunks.
        assert "".join("".join(plain).split()) == "".join(texts[doc].split())
        assert [r["next_id"] for r in rows[:-1]] == [r["chunk_id"] for r in rows[1:]] or len(rows) < len(plain)
        assert rows[0]["start"] == 0 and rows[0]["overlap_size"] == 0 and all(0 <= r["position"] <= 1 and 0 <= r["quality"] <= 1 for r in rows)

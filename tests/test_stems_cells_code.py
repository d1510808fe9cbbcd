"""Stems, coarse vector cells, and code elements."""

import re

import pytest
from pyspark.sql import functions as F

from quern.functions import stem
from quern.operators import code, vectors
from quern.operators import chunking as C
from quern.operators import search as S
from quern.plans import table_queries
from quern.sources import derived as D

SF = "/root/testdata/sf0.1"

# Words and stems of the published description of the algorithm.
PAIRS = """
caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi
sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic
differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis
hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal
electriciti electr electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog
communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas
controll control roll roll generalizations gener oscillators oscil
""".split()


def test_stems(spark):
    assert {w: stem.stem(w) for w in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2]))
    assert [stem.stem(w) for w in ("is", "naïves", "x86s", "")] == ["is", "naïves", "x86s", ""]
    df = spark.createDataFrame([(1, "hopping"), (2, "hopes"), (3, "hopping"), (4, "Ünits")], "k long, term string")
    assert sorted(tuple(r) for r in stem.stemmed(df).select("k", "stem").collect()) == [(1, "hop"), (2, "hope"), (3, "hop"), (4, "Ünits")]


def test_search_by_stems(spark):
    docs = spark.createDataFrame([(1, "connections were adjusted"), (2, "connected"), (3, "nothing else")], "doc_id long, content string")
    q = spark.createDataFrame([(1, "connecting adjustable")], "item_id long, query string")
    assert [r["doc_id"] for r in S.search_fields(docs, q, {"content": 1.0}, stem=True).orderBy("rank").collect()] == [1, 2]
    assert S.search_fields(docs, q, {"content": 1.0}).count() == 0


def test_cells_reach_their_recall(spark):
    e = D.table(spark, SF, "embeddings").select("vec_id", "embedding")
    # The given vectors form no groups; drawn towards 20 of them they do, and then few cells are enough.
    hubs = e.where("vec_id < 20").select(F.col("vec_id").alias("hub"), F.col("embedding").alias("h"))
    drawn = e.join(F.broadcast(hubs), F.col("vec_id") % 20 == F.col("hub")).select("vec_id", F.zip_with("embedding", "h", lambda x, y: (x * 0.3 + y).cast("float")).alias("embedding"))
    for vectors_, most in ((e, 1.0), (drawn, 0.34)):
        q = vectors_.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
        index, exact = vectors.VectorIndex(vectors_), S.vector_search(vectors_, q, 10, 0.1)
        assert vectors.recall(index.search(q, 10, 0.1), exact) >= 0.9
        assert index.probes <= most * len(index.centroids) and len(index.centroids) > 16
        assert sorted(map(tuple, index.search(q, 10, 0.1, exact=True).collect())) == sorted(map(tuple, exact.collect()))
        assert index.rows().count() == vectors_.count()


def test_cells_of_few_rows(spark):
    e = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(5)], "vec_id long, embedding array<float>")
    q = e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    assert vectors.VectorIndex(e).search(q, 2).groupBy("q").count().where("count = 2").count() == 5
    assert vectors.VectorIndex(e.limit(0)).search(q, 2).count() == 0


def brute_end(text, start):
    """The first brace's end, character by character."""
    depth, mode, k = 0, "", start
    # What stands before decides whether the start lies in a comment or string; the fixtures begin outside.
    while k < len(text):
        c = text[k]
        if mode:
            if c == "\\" and mode != "//":
                k += 1
            elif c == "\n" or c == mode:
                mode = ""
        elif text.startswith("//", k):
            mode = "//"
        elif c == '"':
            mode = '"'
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return k + 1
        k += 1
    return -1


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_code_elements_over_documents(spark, sf):
    made = {r["doc_id"]: r for r in table_queries.code_of(spark, sf).collect()}
    got = {}
    for r in table_queries.QUERIES["d7_code_elements"](spark, sf).collect():
        got.setdefault(r["doc_id"], set()).add((r["kind"], r["name"], r["start"], r["stop"]))
    for doc, row in made.items():
        text, language, expected = row["code"], row["language"], set()
        for kind, shapes in (("function", code.FUNCTIONS), ("class", code.CLASSES)):
            for m in re.finditer(shapes.get(language, "(?!)"), text, re.M):
                if language == "python":
                    own = len(m.group(1))
                    later = [x for x in re.finditer(r"^( *)[^ \n]", text, re.M) if x.start() > m.start() and len(x.group(1)) <= own]
                    end = later[0].start() if later else -1
                else:
                    end = brace_end if (brace_end := brute_end(text, m.start())) >= 0 else -1
                expected.add((kind, m.groups()[-1], m.start(), end if end >= 0 else min(m.start() + 1000, len(text))))
        assert got.get(doc, set()) == expected, (doc, language)
        assert len(expected) >= len([x for x in row["code"].split("\n") if "return '" in x or "if (x)" in x])


def test_code_scanner_and_edges(spark):
    text = 'function a() {\n  s = "}"; /* } */ t = `}\n}`; // }\n  if (x) { y }\n}\nfunction b() {\n'
    assert list(code.elements(text, "javascript")) == [("function", "a", 0, text.index("function b")  - 1), ("function", "b", text.index("function b"), len(text))]
    assert list(code.elements("class A:\n  def f(x):\n    return 1\n\n  def g(x):\n    pass\nend = 1\n", "python")) == [("class", "A", 0, 56), ("function", "f", 9, 35), ("function", "g", 35, 56)]
    df = spark.createDataFrame([(1, None, "c"), (2, "int f(int x) {}", "cobol"), (3, "", "c"), (None, "int f(int x) {}", "c")], "doc_id long, code string, language string")
    assert [tuple(r) for r in code.code_elements(df, "code", "language").collect()] == [(None, "c", "function", "f", 0, 15)]


def test_windows_move_no_text(spark):
    df = spark.createDataFrame([(1, "ab" * 30 + " " * 60 + "cd" * 30), (1, "x"), (None, "y"), (2, ""), (3, None)], "doc_id long, t string")
    cut = C.fixed_windows(df, "t", 50, 40)
    assert sorted(tuple(r) for r in cut.where("doc_id = 1").select("chunk_index", "start", "stop").collect()) == [(0, 0, 1), (0, 0, 50), (1, 40, 90), (2, 80, 130), (3, 120, 170), (4, 160, 180)]
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()


def test_postings_of_asked_terms_equal_those_of_all(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "Hopping lists"[: k % 14], " ".join(["hopping hoped list the"] * (k % 4) + ["zeta"])) for k in range(30)] + [(99, None, None)], "doc_id long, title string, content string")
    q = spark.createDataFrame([(1, "hopping list"), (2, "zeta unseen")], "item_id long, query string")
    for stem_too in (False, True):
        rows = lambda: sorted(map(str, S.search_fields(docs, q, {"title": 2.0, "content": 1.0}, stem=stem_too).collect()))  # noqa: B023, E731
        asked = rows()
        monkeypatch.setattr(S, "SMALL", -1)
        assert asked == rows() and len(asked) > 10
        monkeypatch.undo()
    wanted = spark.createDataFrame([(2, "zeta")], "item_id long, term string")
    index, sizes = S._field_postings(docs, {"content": S.index_terms("content")}, wanted, False)
    assert {r["term"] for r in index.collect()} == {"zeta"} and [r["total"] for r in sizes.collect()] == [30.0]

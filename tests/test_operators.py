"""Invariants and golden values worked out by hand."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.operators import links
from quern.operators import metrics as M
from quern.operators import search as S
from quern.plans.table_queries import code_shape, programming_language
from quern.sources import derived as D
from quern.sources import tables

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (T.markdown_to_plain, "# Head\n\n- item **bold** [link](u) ![pic](v) `code`\n> quote", "Head item bold link code quote"),
        (T.clean, "a  b\n\nc ====d", "a b c d"),
        (T.sentences, "One. Two!  Three? ", ["One", "Two", "Three"]),
        (T.index_word_count, "I am 42 years old, naïve", 4),
        (T.urls, "see https://a.b/c and https://a.b/c and http://x.y", ["http://x.y", "https://a.b/c"]),
        (T.email_count, "a@b.de a@b.de c@d.org", 2),
        (T.versions, "v 1.2.3 and 4.5", ["1.2.3", "4.5"]),
        (T.tags, "text #Alpha and #be @tag:Gamma", ["alpha", "gamma"]),
        (T.topics, "the API reads a config", ["api", "configuration"]),
        (T.intent, "How do I install it", "procedure"),
        (T.intent, "what is an error", "explain"),
        (T.tokens_simple, "x" * 40, 10),
        (T.tokens_detailed, "two words, here.", 4),
        (T.is_json_like, ' {"a": 1} ', True),
        (T.snippet, "Short. This sentence has the right size. More", "This sentence has the right size"),
        (T.html_to_text, "<p>a &amp; b</p><script>x</script>", "a & b"),
        (T.shorten, "in order to go\nIn order to go\nnow", "to go now"),
        (T.normalized_query, "  The  API of THE database ", "api database"),
        (T.code_blocks, "```py\nx = 1\n```", None),
    ],
)
def test_text(spark, function, text, expected):
    got = one(spark, text, function(F.col("t")))
    if expected is None:
        assert [tuple(b) for b in got] == [("py", "x = 1\n", 6)]
    else:
        assert got == expected


def test_code(spark):
    shape = {k: one(spark, "f(x[1]) {\n  - a\n    - b\n}", c) for k, c in code_shape("t").items()}
    assert shape == {"indents": 3, "balanced": True, "list_level": 2}
    assert one(spark, "f(x]", code_shape("t")["balanced"]) is False
    assert one(spark, "def f(x):\n  pass", programming_language(F.col("t"))) == "python"
    assert one(spark, "prose only", programming_language(F.col("t"))) is None


@pytest.mark.parametrize("strategy", ["sentence", "paragraph", "heading", "structural", "hybrid", "semantic", "adaptive", "definition"])
def test_chunks_lose_no_words(spark, strategy):
    md = D.markdown(spark, SF).limit(40).cache()
    whole = {r["doc_id"]: sorted(re.findall(r"\w+", r["md"])) for r in md.collect()}
    got: dict = {}
    how = {"carry": 0} if strategy == "sentence" else {}
    for r in C.chunk(md, "md", strategy, **how).collect():
        got.setdefault(r["doc_id"], []).extend(re.findall(r"\w+", r["content"]))
    assert {k: sorted(v) for k, v in got.items()} == whole


def test_merge_next(spark):
    """Against the rule step by step: a short chunk takes the next one of its kind, code never does."""
    import random

    draw = random.Random(2)
    rows = [(d, i, draw.choice(["a", "a", "b", "code"]), draw.choice("xy") * draw.choice([1, 3, 9]), draw.random() < 0.8) for d in range(30) for i in range(draw.randrange(1, 12))]
    out = C.merge_next(spark.createDataFrame(rows, "doc_id long, chunk_index long, kind string, content string, whole boolean"), 5, ["kind"], [], F.col("kind") == "code")
    got = {(r["doc_id"], r["chunk_index"]): r["content"] for r in out.collect()}
    expected = {}
    for d in range(30):
        own = [r for r in rows if r[0] == d]
        i = k = 0
        while i < len(own):
            _, _, kind, text, whole = own[i]
            takes = whole and len(text) < 5 and kind != "code" and i + 1 < len(own) and own[i + 1][2] == kind
            expected[d, k] = f"{text}\n\n{own[i + 1][3]}" if takes else text
            i, k = i + 1 + takes, k + 1
    assert got == expected


def test_chunk_sizes(spark):
    """What can be cut is within the limits."""
    text = "\n\n".join(" ".join(f"Sentence {i} {k} has some words." for k in range(9 if i % 7 else 400)) for i in range(60))
    df = spark.createDataFrame([(1, "# One\n\n" + text), (2, "x" * 5000), (3, ""), (4, "short"), (5, None)], "doc_id long, t string")
    for strategy in ("semantic", "structural", "hybrid", "adaptive"):
        rows = C.chunk(df, "t", strategy).where("doc_id = 1").collect()
        limit = {"structural": 14_000}.get(strategy, 2000 + 202)
        assert max(len(r["content"]) for r in rows) <= limit, strategy
        assert sorted(r["chunk_index"] for r in rows) == list(range(len(rows)))
        assert C.chunk(df, "t", strategy).where("doc_id = 2").count() == 1, strategy


def test_boundary_strength(spark):
    t = "Take these:" + "\n\n" + "- one" + "x" * 60 + "\n\n" + "also this" + "y" * 60 + '"' + "\n\n" + '"end'
    df = spark.createDataFrame([(1, t)], "doc_id long, t string")
    b = C.boundaries(df, "t").where("kind = 'paragraph'")
    assert [r["strength"] for r in C.adjusted(b).orderBy("position").collect()] == [1.0, 0.8, 0.35]


def test_pack(spark):
    df = spark.createDataFrame([(1, "aa|bbb|c|dddd|e")], "doc_id long, t string")
    groups = df.select(C.pack(F.split("t", r"\|"), 5).alias("g")).first()["g"]
    assert [tuple(g) for g in groups] == [(1, 2), (3, 4), (5, 5)]
    carried = df.select(C.pack(F.split("t", r"\|"), 6, carry=1).alias("g")).first()["g"]
    assert [tuple(g) for g in carried] == [(1, 3), (3, 5)]
    assert df.select(C.pack(F.expr("cast(array() as array<string>)"), 6).alias("g")).first()["g"] == []


def test_recursive_sizes(spark):
    out = C.recursive(D.table(spark, SF, "documents"), "text", 300, 60)
    assert out.agg(F.max("char_count")).first()[0] <= 300
    assert out.select("chunk_id").distinct().count() == out.count()


def test_upsert_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string")
    first = tables.upsert(old, new, ["k"])
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, tables.upsert(first, new, ["k"]).collect())) == [(1, "a"), (2, "x"), (3, "y")]


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# hi\nthere")
    (tmp_path / "a" / "y.TXT").write_text("  \n")
    (tmp_path / "z.bin").write_text("no")
    rows = tables.read_tree(spark, str(tmp_path), ["md", "txt"]).collect()
    assert [r["text"] for r in rows] == ["# hi\nthere"]


def test_percentile_rules(spark):
    df = spark.range(1, 101).select(F.lit("a").alias("g"), F.col("id").cast("double").alias("v"))
    s = M.summary(df, "g", "v", 90).first()
    assert (s["p95"], s["p99"], s["median"], s["slow"]) == (96, 100, 50.5, 0.1)
    assert M.exclusive_quantile(df, "g", "v", {"p95": 0.95}).first()["p95"] == 95.95


def test_fit_window(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u" * 40), (1, 2, "assistant", "a"), (1, 3, "user", "b")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(r["turn"] for r in M.fit_window(m, T.tokens_chunk("text"), 16).collect()) == [0, 2, 3]


def test_links(spark):
    e = spark.createDataFrame([(1, "inherits", 2), (2, "inherits", 3), (3, "inherits", 1), (1, "related", 4), (4, "related", 5)], "src long, type string, dst long")
    got = {(r["node"], r["type"], r["depth"]) for r in links.follow(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {(2, "inherits", 1), (3, "inherits", 2), (4, "related", 1)}
    chain = spark.createDataFrame([(i, "up", i + 1) for i in range(20)] + [(20, "up", 5)], "src long, type string, dst long")
    up = {(r["node"], r["depth"]) for r in links.follow(chain, spark.createDataFrame([(0,)], "node long")).collect()}
    assert up == {(i, i) for i in range(1, 21)}


def test_search_bounds(spark):
    q = D.user_queries(spark, SF)
    best = S.bm25(S.postings(D.table(spark, SF, "documents"), "doc_id", "text"), q, "doc_id", 5)
    assert best.groupBy("item_id").count().agg(F.max("count")).first()[0] <= 5
    docs = D.table(spark, SF, "documents").select("doc_id", "source", F.lit("md").alias("kind"), F.array_distinct(T.words("text")).alias("words"))
    assert S.diverse(best.join(docs, "doc_id"), 4).groupBy("item_id").count().agg(F.max("count")).first()[0] <= 4
    e = S.hashed_embedding(D.table(spark, SF, "documents"), "text")
    norm = F.sqrt(S.dot(F.col("embedding"), F.col("embedding")))
    assert e.select(F.abs(norm - 1).alias("x")).agg(F.max("x")).first()[0] < 1e-5


def test_diversity(spark):
    """Near copies of a source's kept rows go once half is filled; a file type may have a third unless the score is far better."""
    rows = [(1, i, "s" if i < 8 else f"t{i}", f"k{i % 5}", 10.0 - i, i, ["a", "b", str(i // 2)] if i > 3 else [str(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "item_id long, doc_id long, source string, kind string, score double, rank long, words array<string>")
    assert [r["doc_id"] for r in S.diverse(df, 6).orderBy("place").collect()] == [0, 1, 2, 3, 4, 6]
    one_kind = df.withColumn("kind", F.lit("md"))
    assert [r["doc_id"] for r in S.diverse(one_kind, 6).orderBy("place").collect()] == [0, 1]
    assert S.diverse(one_kind, 12).count() == 12


def brute_keyword(docs, terms):
    """Scores of (doc_id, text, path) for terms of (term, op, weight), one document and term at a time."""
    out = {}
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for i, text, path in docs:
        text, path = (text or "").lower(), (path or "").lower()
        s, met, gone = 0.0, set(), False
        for term, op, w in terms:
            own = 0.0
            wild = re.escape(term).replace(r"\*", ".*").replace(r"\?", ".")
            if op == "PHRASE":
                own = 3 * w * (term in text) + 5 * w * (term in path)
            elif op == "WILDCARD":
                own = 1.5 * w * bool(re.search(wild, text)) + 3 * w * bool(re.search(wild, path))
            elif op == "NOT":
                gone = gone or term in text or term in path
            else:
                own = w * len([x for x in re.findall(r"\w+", text) if x == term]) + 2 * w * (term in path)
                if not own:
                    best = max((like(term, x) for x in text.split()), default=0)
                    own = best * 0.5 * w if best > 0.8 else 0.0
            s += own
            met |= {(term, op)} if own else set()
        wants = {(t, o) for t, o, _ in terms if o == "AND"}
        s *= 1.0 if wants <= met else 0.1
        s *= 0.3 if any(o == "OR" for _, o, _ in terms) and not any(o == "OR" for _, o in met) else 1.0
        if s > 0 and not gone:
            out[i] = round(s, 6)
    return out


def test_keyword_scores(spark):
    docs = [(1, "Alpha beta gamma. The beta-test, alpha!", "src/alpha.py"), (2, "alpha", "docs/beta gamma.md"), (3, "nothing here\nalphas stressed", "x"), (4, None, "alpha"), (5, "", None), (6, "betas gamm a(b)c desserts", "notes"), (7, "alpha beta gamma " * 3, "src/alpha.py")]
    asked = {
        1: [("beta gamma", "PHRASE", 1.5), ("alpha", "AND", 1.0)], 2: [("alp*a", "WILDCARD", 0.9), ("t?st", "WILDCARD", 0.9)], 3: [("alpha", "AND", 1.0), ("gamma", "NOT", 1.0)], 4: [("desserts", "OR", 1.0), ("nowhere", "OR", 1.0)],
        5: [("alpha", "OR", 1.0), ("missing", "AND", 1.0)], 6: [("a(b*c", "WILDCARD", 0.9)], 7: [("bet", "NOT", 1.0), ("alpha", "AND", 1.0)], 8: [("*", "WILDCARD", 0.9), ("alpha", "AND", 1.0)],
    }
    terms = [(q, k, t, op, w) for q, ts in asked.items() for k, (t, op, w) in enumerate(ts)]
    got: dict = {}
    scores = S.keyword_scores(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(terms, "item_id long, pos int, term string, op string, weight double"))
    for r in scores.collect():
        got.setdefault(r["item_id"], {})[r["doc_id"]] = r["score"]
    for q, ts in asked.items():
        assert got.get(q, {}) == pytest.approx(brute_keyword(docs, [x for x in ts if x[0] != "*"])), q


def test_search_fields_pages(spark):
    docs = spark.createDataFrame([(i, "zebra" if i == 3 else "other", None if i % 2 else "zebra notes", "the zebra " * (i + 1), "en" if i != 4 else "de") for i in range(9)], "doc_id long, title string, headings string, content string, lang string")
    q = spark.createDataFrame([(1, "zebra")], "item_id long, query string")
    pages = [S.search_fields(docs, q, filters={"lang": "en"}, page=p, page_length=3).orderBy("rank").collect() for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [3, 3, 2, 0] and {(r["total"], r["pages"]) for p in pages for r in p} == {(8, 3)}
    assert pages[0][0]["doc_id"] == 3 and [r["rank"] for p in pages for r in p] == list(range(1, 9))
    assert pages[0][0]["preview"].startswith("the zebra") and all(r["doc_id"] != 4 for p in pages for r in p)


def test_vector_blocks(spark, monkeypatch):
    e = D.table(spark, SF, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    whole = sorted(map(tuple, S.vector_search(e, q, 5).collect()))
    monkeypatch.setattr(S.against_all, "__defaults__", (3,))
    assert sorted(map(tuple, S.vector_search(e, q, 5).collect())) == whole


def test_accuracy_by_expected_content(spark):
    df = spark.createDataFrame([("q", "It uses OAuth2 and tokens.", ["oauth2", "saml"]), ("q", "x", []), ("q", "x", None)], "question string, reply string, expected array<string>")
    assert [r["accuracy"] for r in M.response_scores(df, "expected").select("accuracy").collect()] == [0.5, 0.8, 0.8]


def test_filter_and_columns_reach_the_scan(spark):
    plan = D.table(spark, SF, "events").where("event_type = 'click'").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_packing_takes_time_in_proportion_to_the_pieces(spark):
    import time

    from pyspark.sql import functions as F

    from quern.operators import chunking as C

    text = "".join(f"word{i} alpha beta. " for i in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, t string")
    before = time.time()
    n, last = C.by_sentence_size(df, "t").agg(F.count("*"), F.max("chunk_index")).first()
    assert n == last + 1 and n > 900
    assert time.time() - before < 30


@pytest.mark.parametrize("terms", [S.TERMS, 0])
def test_keyword_scores_scan_and_index_equal_brute_force(spark, monkeypatch, terms):
    rng = random.Random(8)
    words = ["alpha", "alphas", "beta", "be", "a", "gamma", "a.b", "(x", "é", "desserts", "stressed", "alpha-beta"]
    docs = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\n", "\t"]) for _ in range(rng.randint(0, 12))), rng.choice(["src/alpha.py", "beta gamma", "a.b", None])) for k in range(120)] + [(900, None, "alpha"), (901, "", None)]
    marks = ["a", "b", "al", "ph", "*", "?", "??", ".", "é"]
    asked = {}
    for q in range(60):
        wild = "".join(rng.choice(marks) for _ in range(rng.randint(1, 5))) + rng.choice(["*", "?"])
        two = rng.choice(words) + rng.choice([" ", "  "]) + rng.choice(words)
        asked[q] = [(two, "PHRASE", 1.5), (wild, "WILDCARD", 0.9), (rng.choice(words), "NOT", 1.0), *[(rng.choice(words), op, 1.0) for op in rng.choice([["AND"], ["OR", "OR"], ["AND", "AND", "OR"]])]][rng.choice([0, 0, 3]) :]
    asked = {q: [t for t in ts if re.search(r"[^*?\s]", t[0])] for q, ts in asked.items()}
    monkeypatch.setattr(S, "TERMS", terms)
    rows = [(q, k, t, op, w) for q, ts in asked.items() for k, (t, op, w) in enumerate(ts)]
    scores = S.keyword_scores(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame(rows, "item_id long, pos int, term string, op string, weight double"))
    got: dict = {}
    for r in scores.collect():
        got.setdefault(r["item_id"], {})[r["doc_id"]] = r["score"]
    for q, ts in asked.items():
        assert got.get(q, {}) == pytest.approx(brute_keyword(docs, ts)), (q, ts)


def test_keyword_scores_make_no_table_of_words(spark, monkeypatch):
    from quern.operators import wordindex as X

    def refused(*args):
        raise AssertionError("a vocabulary of all texts was made")

    monkeypatch.setattr(X, "vocabulary", refused)
    docs = spark.createDataFrame([(1, "alpha beta", "x")], "doc_id long, text string, source string")
    terms = spark.createDataFrame([(1, 0, "alpha", "AND", 1.0), (2, 0, "be*", "WILDCARD", 0.9)], "item_id long, pos int, term string, op string, weight double")
    assert sorted(map(tuple, S.keyword_scores(docs, terms).collect())) == [(1, 1, 1.0), (2, 1, 1.35)]


def test_adaptive_cuts_texts_where_they_are_read(spark, monkeypatch):
    texts = ["lead\n# A\nbody\n## B\n| a | b |\n", "# A\n\n#  \t\n#x\n####### no\n###### F f", "", "plain", "a\r\n# H\x0b\n# \xa0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, t string")
    for d, t in enumerate(texts):
        starts = [r["start"] for r in C.sections(df.where(F.col("doc_id") == d), "t").orderBy("sec").collect()]
        assert C._by_heading(t) == [t[a:b] for a, b in zip([0, *starts], [*starts, None])], t
    monkeypatch.setattr(C, "sections", lambda *_: pytest.fail("sections were joined back with their texts"))
    got = {(r["doc_id"], r["sec"]) for r in C.adaptive(df, "t").collect()}
    assert {(0, 0), (0, 1), (0, 2), (3, 0)} <= got and all(d != 2 for d, _ in got)

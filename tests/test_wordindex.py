"""Parts of words, likeness and patterns by the word index, against brute force."""

import random
import re

import pytest

from quern.operators import wordindex as X


def brute(texts, terms):
    """Rows (item_id, pos, key) by regular expressions over whole texts."""
    out = set()
    for item, pos, term, wild in terms:
        shape = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in term) if wild else re.escape(term)
        if re.search(r"[^*?\s]", term):
            out |= {(item, pos, key) for key, text in texts if text is not None and re.search(shape, text)}
    return out


def found(spark, texts, terms):
    df = spark.createDataFrame(texts, "key long, text string")
    asked = spark.createDataFrame(terms, "item_id long, pos int, term string, wild boolean")
    return X.matches(df, "key", "text", asked, X.vocabulary(df, "text"))


@pytest.mark.parametrize("few", [True, False])
def test_patterns_equal_brute_force(spark, monkeypatch, few):
    rng = random.Random(5)
    letters = ["a", "b", "ab", "ba", " ", " ", "  ", "\n", "\t", "abc", "é", "a.b", "(x"]
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 8, 25])))) for k in range(150)] + [(900, None), (901, ""), (902, "abab" * 12)]
    marks = ["a", "b", "ab", "?", "??", "*", "**", "é", ".", "(", "?*", "*?"]
    terms = [(k, 0, "".join(rng.choice(marks) for _ in range(rng.randint(1, 6))), True) for k in range(120)]
    words = ["a", "b", "ab", "ba", "abc", "a.b", "(x"]
    terms += [(k, 1, rng.choice(["", "a", "b"]) + rng.choice([" ", "  ", "\t"]).join(rng.choice(words) for _ in range(rng.randint(1, 4))), False) for k in range(120)]
    terms = [t for t in terms if re.search(r"[^*?\s]", t[2])]
    if not few:
        monkeypatch.setattr(X, "SMALL", 0)
    got = [tuple(r) for r in found(spark, texts, terms).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, terms)


def test_nothing_asked(spark):
    assert found(spark, [(1, "a b")], []).count() == 0
    assert found(spark, [], [(1, 0, "a b", False)]).count() == 0


def test_words_that_hold_parts_and_are_alike(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 9))) for _ in range(800)})
    parts = sorted({w[i : i + n] for w in rng.sample(words, 60) for n in (1, 2, 3, 5) for i in (0, 1)} - {""}) + ["zz", "zzzz"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in X.holding(df, spark.createDataFrame([(p,) for p in parts], "part string")).collect()}
    assert got == {(p, w) for p in parts for w in words if p in w}
    terms = words[::9] + ["abcdefghij", "é"]
    got = {(r["term"], r["word"]) for r in X.alike(df, spark.createDataFrame([(t,) for t in terms], "term string").distinct(), 0.8).collect()}
    assert got == {(t, w) for t in terms for w in words if len(set(t) & set(w)) > 0.8 * len(set(t) | set(w))}


def test_no_text_is_moved_and_no_pairs_are_tried(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma beta")], "key long, text string")
    asked = spark.createDataFrame([(1, 0, "beta gamma", False), (1, 1, "al*g?m", True)], "item_id long, pos int, term string, wild boolean")
    out = X.matches(df, "key", "text", asked, X.vocabulary(df, "text"))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 0, 1), (1, 1, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

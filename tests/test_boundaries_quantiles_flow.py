"""Boundaries, order statistics and the flow report against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quern.operators import chunking as C
from quern.operators import metrics as M
from quern.sources import tables

_END = re.compile(r"[.!?]+[ \t\n\r\f]+")


def brute_boundaries(text):
    """Window by window, each cut out and read afresh."""
    out = [(m.end(), "paragraph", 0.7) for m in re.finditer(r"\n[ \t\n\r\f]*\n", text)]
    parts, at = _END.split(text), 0
    for k, part in enumerate(parts[:-1]):
        at += len(part)
        lead = parts[k + 1].strip(" \t\n\r\f").lower()
        found = [C.TRANSITION_STRENGTH[kind] for kind, words in C.TRANSITIONS.items() for w in words if lead.startswith(w + " ") or lead.startswith(w + ",")]
        found += [0.9] if lead.startswith(("in summary", "to conclude", "in conclusion")) else []
        out += [(at, "sentence", found[0])] if found else []
        at += len(_END.match(text, at).group())
    windows = []
    for i in range(0, len(text) - 200, 50):
        words = [w for w in re.findall(r"\w+", text[i : i + 200].lower()) if re.fullmatch("[a-z]{3,}", w) and w not in C.TOPIC_STOP_WORDS]
        windows.append((i, set(words)))
    for (_, a), (i, b) in zip(windows, windows[1:]):
        similarity = len(a & b) / len(a | b) if a and b else 0.0
        if similarity < 0.75:
            low = max(0, i - 50)
            ends = sorted((abs(low + m.end() - i), low + m.end()) for m in _END.finditer(text[low : min(len(text), i + 50)]))
            place = ends[0][1] if ends else i
            out += [(place, "topic_shift", 1 - similarity)] if place > 0 else []
    return sorted((p, k, round(s, 6)) for p, k, s in out)


def test_boundaries_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "However", "in contrast,", "therefore,", "also", "to conclude", "the", "naïve", "ab", "x1y", "snake_case", "Überall", "later"]
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "!? ", "\n", "\n \n", ".\n\n", "  "]) for _ in range(rng.choice([0, 2, 40, 200, 600])))) for k in range(60)]
    df = spark.createDataFrame([*texts, (100, None), (101, ""), (102, "z" * 5000)], "doc_id long, t string")
    got = {}
    for r in C.boundaries(df, "t").collect():
        got.setdefault(r["doc_id"], []).append((r["position"], r["kind"], round(r["strength"], 6)))
    for k, t in [*texts, (102, "z" * 5000)]:
        assert sorted(got.get(k, [])) == brute_boundaries(t), k
    assert 100 not in got and 101 not in got


def brute_thin(bounds):
    kept = []
    for b in bounds:
        if kept and b[0] - kept[-1][0] < 50:
            if b[2] > kept[-1][2]:
                kept[-1] = b
        else:
            kept.append(b)
    return kept


def test_thinning_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(d, rng.randrange(0, 900), rng.choice(C.KINDS), rng.choice([0.4, 0.7, 0.9]), "", "") for d in range(9) for _ in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, position long, kind string, strength double, before string, after string")
    got = {}
    for r in C.thin(df).collect():
        got.setdefault(r["doc_id"], []).append((r["position"], r["kind"], r["strength"]))
    for d in range(9):
        own = sorted(((p, k, s) for x, p, k, s, _, _ in rows if x == d), key=lambda b: (b[0], C.KINDS.index(b[1]), b[2]))
        # Of one place and kind the weaker come first, so that the stronger takes its place.
        assert sorted(got[d]) == sorted(brute_thin(own)), d


def test_semantic_chunks_are_cut_at_shifts_of_topic(spark):
    # Words so long that a window holds three: every step changes most of them, and no paragraph or transition helps.
    rng = random.Random(8)
    text = ". ".join("".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(40))
    df = spark.createDataFrame([(1, text)], "doc_id long, t string")
    chunks = [r["content"] for r in C.semantic(df, "t").orderBy("chunk_index").collect()]
    assert len(chunks) > 2 and "".join("".join(chunks).split()) == "".join(text.split())


@pytest.mark.parametrize("cells, few", [(1024, 20_000), (4, 3), (2, 1)])
def test_order_statistics(spark, monkeypatch, cells, few):
    monkeypatch.setattr(M, "CELLS", cells)
    monkeypatch.setattr(M, "FEW", few)
    rng = random.Random(9)
    values = {"a": [rng.gauss(0, 1) for _ in range(300)], "b": [5.0] * 200, "c": [rng.choice([1e-9, 1e300, -1e300, 0.0, 7.0]) for _ in range(150)], None: [1.0, 2.0], "d": [10.0 ** rng.randint(-30, 30) for _ in range(200)], "e": [1 + k * 2.0**-52 for k in range(60)]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan")), ("z", None)], "g string, v double")
    got = {r["g"]: (r["first"], r["p95"], r["last"]) for r in M.order_statistics(df, "g", "v", {"first": F.lit(1), "p95": M.nearest_rank(0.95), "last": F.col("n")}).collect()}
    assert got == {g: (min(vs), sorted(vs)[min(len(vs), int(len(vs) * 0.95) + 1) - 1], max(vs)) for g, vs in values.items()}


def test_flow_report_counts_while_writing(spark, tmp_path):
    base = spark.range(100).toDF("k")

    def flow(name, lose=None, fail=None):
        def work(stage):
            def run(before):
                if stage == fail:
                    raise ValueError("no store")
                df = base if before is None else before
                return df.where("k > 0") if stage == lose else df

            return run

        stages = [tables.Stage("documents", work("documents")), tables.Stage("chunks", lambda d: d.union(d)), tables.Stage("embeddings", work("embeddings"), same=True), tables.Stage("stored", work("stored"), same=True)]
        report, last = tables.run_flow(spark, stages, str(tmp_path / name))
        return {r["stage"]: (r["status"], r["n"], r["passed"], r["error"]) for r in report.collect()}, report, last

    rows, report, last = flow("good")
    assert rows == {"documents": ("SUCCESS", 100, True, None), "chunks": ("SUCCESS", 200, True, None), "embeddings": ("SUCCESS", 200, True, None), "stored": ("SUCCESS", 200, True, None), "overall": ("SUCCESS", 200, True, None)}
    assert last.count() == 200 and all(r["seconds"] > 0 for r in report.collect())
    # A stage that loses rows does not pass, and neither does the whole.
    rows, _, _ = flow("lost", lose="stored")
    assert rows["stored"][:3] == ("SUCCESS", 198, False) and rows["embeddings"][2] and rows["overall"][:3] == ("SUCCESS", 198, False)
    # A stage that fails ends the flow.
    rows, _, last = flow("failed", fail="embeddings")
    assert rows["embeddings"] == ("FAILED", None, False, "no store") and rows["stored"][0] == "SKIPPED" and rows["overall"][0] == "FAILED" and last is None


def test_shifts_alone_equal_the_shifts_among_all_boundaries(spark):
    words = ["alpha", "beta.", "gamma", "however", "delta!", "x1y"]
    rng = random.Random(9)
    df = spark.createDataFrame([(k, " ".join(rng.choice(words) + str(rng.randrange(5)) * rng.randrange(2) for _ in range(300))) for k in range(20)] + [(None, "a b " * 200), (50, None)], "doc_id long, t string")
    alone = C.boundaries(df, "t", ("topic_shift",))
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(alone) == rows(C.boundaries(df, "t").where("kind = 'topic_shift'")) and alone.count() > 20


def test_thinning_where_boundaries_are_found_moves_nothing(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, " ".join(rng.choice(["alpha", "beta.", "however", "gamma!\n\n", "delta"]) for _ in range(400))) for k in range(9)] + [(50, None)], "doc_id long, t string")
    found = C.boundaries(df, "t", apart=50)
    rows = lambda x: sorted(map(str, x.select("doc_id", "position", "kind", "strength").collect()))
    assert rows(found) == rows(C.thin(C.boundaries(df, "t"))) and found.count() > 50
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_semantic_cuts_keep_words_whole():
    assert C._cut_at("alpha beta\ngamma delta", [8, 11]) == ["alpha", "beta", "gamma delta"]
    assert C._cut_at("x" * 500, [300]) == ["x" * 300, "x" * 200] and C._cut_at("", []) == [] and C._cut_at("a  b", [2]) == ["a", "b"]

"""Lexical search, SentencePiece and centroid clustering against brute force, the library, and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from test_ops import EDGES, SF

from quern.llm import op11_lexical, op12_sentencepiece, op13_centroids


# ---- 11

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = {c: c + 32 for c in range(65, 91)}


def brute_ranking(docs, items, k=10):
    """Rows (item row, rank, doc_id, score) by the definition."""
    terms = [_TERM.findall((t or "").translate(_FOLD)) for _, t in docs]
    n_docs, length = sum(map(bool, terms)), sum(map(len, terms))
    df, out = Counter(t for ts in terms for t in set(ts)), []
    for row, (item, text) in enumerate(items):
        found = []
        for (doc, _), ts in zip(docs, terms):
            tf, score = Counter(ts), 0
            for t in set(_TERM.findall((text or "").translate(_FOLD))):
                if tf[t]:
                    m = 10 + 90 * len(ts) * n_docs // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def rows(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def tables(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "no": F.lit(2), "rank": F.lit("x"), "item_id": F.lit(None)})
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(0))


def test_search_edges(spark, monkeypatch):
    texts = [*EDGES, "a b", "A-B c", "a7b\x7fa", "éA Éa éa", "same text", "same text", "same text"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "same text"), (3, "same text"), (3, "same text"), (-5, "same text")]
    items = [(0, "a b c"), (1, None), (2, ""), (3, "same"), (3, "same"), (None, "same text A"), (5, "nowhere absent"), (6, "éa ßtraße 日本語 a7b"), (7, " ".join(t or "" for t in texts))]
    expected = Counter(brute_ranking(docs, items))
    assert rows(op11_lexical.search(*tables(spark, docs, items))) == expected
    # Blocks of one or two items, and cuts after every few documents, change nothing.
    monkeypatch.setattr(op11_lexical, "BLOCK_ITEMS", 2)
    monkeypatch.setattr(op11_lexical, "BLOCK_BYTES", 12)
    assert rows(op11_lexical.search(*tables(spark, docs, items))) == expected


def test_search_empty(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    for d, i in ((docs, []), ([], items), ([], []), ([(1, None), (2, "--")], items), (docs, [(1, None)])):
        out = op11_lexical.search(*tables(spark, d, i))
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4), st.one_of(st.none(), st.integers(0, 30))), max_size=200), st.integers(1, 5))
def test_best_keeps_the_best(found, k):
    best = op11_lexical.Best(4, k)
    for item, score, doc in found:
        best.add(np.array([item]), np.array([score]), np.array([doc or 0]), np.array([doc is None]))
        if random.random() < 0.1:
            best.cut()
    got = Counter((int(i), int(s), None if n else int(d)) for i, s, d, n in zip(*best.cut()))
    expected = Counter()
    for i in range(4):
        expected.update(sorted((x for x in found if x[0] == i), key=lambda x: (-x[1], x[2] is None, x[2] or 0))[:k])
    assert got == expected


# ---- 12


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path(op12_sentencepiece.MODEL)
    return op12_sentencepiece.Model(path), sentencepiece.SentencePieceProcessor(model_file=path)


def spans_of(library, text):
    """The library's spans; they count bytes."""
    return [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def agree(pieces, text):
    own, library = pieces
    ids, starts, ends = own.encode(text)
    assert ids == library.encode(text)
    assert list(zip(starts, ends)) == spans_of(library, text)
    assert own.decode(ids) == library.decode(ids)


def test_pieces_equal_library(spark, pieces):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    edge = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(EDGES)] + [(None, "no id", "y", 2)], "doc_id long, text string, ids string, c0 int")
    for df, source in ((op12_sentencepiece.query(spark, SF), docs), (op12_sentencepiece.digests(edge, public_tokenizers.path(op12_sentencepiece.MODEL), ["doc_id", "ids", "c0"]), edge)):
        expected = Counter()
        for r in source.collect():
            ids = pieces[1].encode(r["text"] or "")
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), pieces[1].decode(ids))]
            expected[r["doc_id"], len(ids), *sha] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in df.collect()) == expected


def test_pieces_round_trip(spark, pieces):
    path = public_tokenizers.path(op12_sentencepiece.MODEL)
    edge = spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "doc_id long, text string")
    coded = op12_sentencepiece.encode(edge, path, ["doc_id", "text"])
    for r in coded.collect():
        whole = (r["text"] or "").encode()
        # Spans follow each other and cover every byte.
        assert r["starts"] == ([0, *r["ends"][:-1]] if r["ends"] else []) and (r["ends"] or [0])[-1] == len(whole)
    for r in op12_sentencepiece.decode(coded, path, ["text"]).collect():
        assert r["decoded"] == (r["text"] or "")
    empty = op12_sentencepiece.digests(edge.limit(0), path, ["doc_id"])
    assert empty.count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeinrst  ▁▁\n\t.,!?019éñßΣ日本語😀\x00<s>/"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_of_any_text(pieces, text):
    agree(pieces, text)


def test_pieces_of_long_runs(pieces):
    rng = random.Random(7)
    for text in ("a" * 5000, "日" * 700, " " * 3000, "".join(rng.choice("abt") for _ in range(9000)), "x▁" * 900):
        agree(pieces, text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31999), st.integers(0, 258), st.integers(0, 3), st.just(28705)), max_size=9))
def test_pieces_decode_any_ids(pieces, ids):
    assert pieces[0].decode(ids) == pieces[1].decode(ids)


def test_pieces_in_blocks(pieces, monkeypatch):
    monkeypatch.setattr(op12_sentencepiece, "BLOCK", 3)
    monkeypatch.setattr(op12_sentencepiece, "MEMO", 5)
    for text in EDGES:
        if text and len(text) < 4000:
            agree(pieces, text)


def message(number, value):
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    return varint(number << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(number << 3) + varint(value)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix, squeeze", [(1, 0), (1, 1), (0, 1), (0, 0)])
def test_pieces_with_a_character_map(tmp_path, rule, prefix, squeeze):
    """The library's own compiled maps in front of the same pieces."""
    fields = op12_sentencepiece.fields
    with open(public_tokenizers.path(op12_sentencepiece.MODEL), "rb") as f:
        body = b"".join(message(n, v) for n, v in fields(f.read()) if n != 3)
    spec = dict(fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()))[3]
    path = tmp_path / "made.model"
    path.write_bytes(body + message(3, message(1, rule.encode()) + message(2, dict(fields(spec))[2]) + message(3, prefix) + message(4, squeeze) + message(5, 1)))
    both = op12_sentencepiece.Model(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng, alphabet = random.Random(11), [*"abcde ①ﬁ㌔Å가각éñ　 \t\n▁Ａ½…ß", "  ", "é", "\r\n", "​"]
    for _ in range(600):
        agree(both, "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 6, 20]))))


# ---- 13


def brute_clusters(vectors, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    last = [(i, *near(v)) for i, v in kept]
    of = Counter()
    for _, d, j in last:
        of[j] += d
    return Counter((i, j, d, of[j], sum(of.values()), tuple(centroids[j])) for i, d, j in last)


def clusters(df):
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in df.collect())


def test_clusters_edges(spark):
    rng = random.Random(2)
    make = lambda scale: [np.float32(rng.uniform(-scale, scale)).item() for _ in range(64)]
    vectors = [(i, make(rng.choice([0.1, 1, 1, 40]))) for i in range(90)]
    vectors += [(90, None), (91, []), (92, [0.5] * 63), (93, [0.5] * 65), (94, [None] + [0.5] * 63), (95, [math.nan] + [0.5] * 63), (96, [math.inf] * 64), (97, [-0.0] * 64), (98, [1.0] * 64), (98, [1.0] * 64), (None, [-1.0] * 64)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumns({"bits": F.lit("x"), "cluster": F.lit(1), "norm": F.lit(None)})
    assert clusters(op13_centroids.cluster(df)) == brute_clusters(vectors)
    few = vectors[:3] + vectors[-3:-1]
    assert clusters(op13_centroids.cluster(df.where("vec_id in (0, 1, 2, 98)"))) == brute_clusters(few)  # fewer vectors than centroids, equal ones among them
    assert op13_centroids.cluster(df.where("vec_id between 90 and 96")).count() == 0


def test_clusters_say_what_is_too_large(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        op13_centroids.cluster(df).count()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**26), 2**26 - 1), min_size=64, max_size=64), min_size=1, max_size=4))
def test_planes_are_exact(vectors):
    v = np.array(vectors, np.int64)
    planes = op13_centroids.planes_of(v, op13_centroids.needed(v))
    for w in v:
        other = op13_centroids.planes_of(w[None], op13_centroids.needed(w))[0]
        assert op13_centroids.dots(planes, other).tolist() == [sum(a * b for a, b in zip(x, w.tolist())) for x in vectors]
    assert op13_centroids.component_sums(planes).tolist() == v.sum(0).tolist()

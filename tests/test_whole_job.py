"""Queries over all rows, against brute force on small fixtures."""

from __future__ import annotations

import re
import pytest

from quern.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def write(spark, tmp_path_factory):
    def put(**tables):
        base = str(tmp_path_factory.mktemp("fixture"))
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{base}/{name}.parquet")
        return base

    return put


def brute_word_chunks(text, limit=256, carry=6):
    p = [text] if len(text) <= limit else [w for w in re.split(r"\s+", text, flags=re.A) if w]
    out, first, size = [], 0, 0
    for i, w in enumerate(p):
        if size and size + len(w) + 1 > limit:
            out.append(p[first:i])
            first = max(first, i - carry)
            size = sum(len(x) + 1 for x in p[first:i])
        size += len(w) + 1
    return [" ".join(x) for x in [*out, p[first:]] if x]


def test_word_window_takes_long_texts(spark, write):
    import hashlib

    texts = {1: "short", 2: " ".join(f"w{i % 97}" for i in range(4000)), 3: "x" * 5000, 4: "a \n b\t" * 900, 5: ("y" * 300 + " z ") * 12, 6: None, 7: ""}
    d = write(documents=([(i, t) for i, t in texts.items()], "doc_id long, text string"))
    got = {(r["doc_id"], r["chunk_index"]): r["content_md5"] for r in registry.queries()["d22_chunk_word_window"](spark, d).collect()}
    assert got == {(i, k): hashlib.md5(c.encode()).hexdigest() for i, t in texts.items() if t is not None for k, c in enumerate(brute_word_chunks(t))}

"""c34 over all documents, against brute force."""

from __future__ import annotations

import re

import pytest

from quern.plans import registry

from test_whole_job import write  # noqa: F401

DOCS = [(1, "Red apples and green pears."), (7, "the the the"), (50, "green hills"), (51, "nothing in common"), (99, ""), (100, None), (149, "red red RED pears grow on the hills")]
ITEMS = [(0, "Red pears grow here"), (3, "the green hills far away from home"), (11, "unmatched")]


def word_set(text):
    return set(re.findall(r"\w+", (text or "").lower()))


def test_set_similarity_takes_all_documents(spark, write):  # noqa: F811
    d = write(documents=(DOCS, "doc_id long, text string"), benchmark=(ITEMS, "item_id long, text string"))
    expected = {}
    for i, q in ITEMS:
        a = word_set(" ".join(q.split()[:6]))
        expected |= {(i, k): round(len(a & b) / len(a | b), 6) for k, b in ((k, word_set(t)) for k, t in DOCS) if a & b}
    got = {(r["item_id"], r["doc_id"]): r["similarity"] for r in registry.queries()["c34_set_similarity"](spark, d).collect()}
    assert got == pytest.approx(expected) and any(k % 50 for _, k in got)

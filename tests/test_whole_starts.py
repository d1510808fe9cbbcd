"""f10 for all items and e8 from all pages, against brute force."""

from __future__ import annotations

import re

import pytest

from quern.operators import links
from quern.plans import registry

from test_whole_job import SF, write  # noqa: F401


def word_set(text):
    return set(re.findall(r"\w+", text.lower()))


def test_best_chunk_for_all_items(spark, write):  # noqa: F811
    docs = [(1, "red apples " * 60 + "green pears " * 60, "s"), (2, "pears", "s"), (3, "none of it", "s")]
    items = [(0, "red apples"), (1, "green pears grow"), (4, "apples"), (7, "zzz")]
    d = write(documents=(docs, "doc_id long, text string, source string"), benchmark=(items, "item_id long, text string"))
    expected = {}
    for i, q in items:
        for k, text, source in docs:
            md, a = f"# {source}\n\n{text}", word_set(q)
            cuts = [md[s : s + 500] for s in range(0, max(len(md) - 51, 0) + 1, 450)]
            best = max((len(a & word_set(c)) / len(a | word_set(c)), -n) for n, c in enumerate(cuts))
            if best[0] > 0:
                expected[i, k] = (round(best[0], 6), -best[1])
    got = {(r["item_id"], r["doc_id"]): (r["similarity"], r["chunk_index"]) for r in registry.queries()["f10_best_chunk_per_document"](spark, d).collect()}
    assert got == expected and {1, 4} <= {i for i, _ in got}


def test_context_from_all_pages(spark):
    pages, kinds = [r[0] for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id").collect()], [k for k, v in links.DEPTHS.items() if v]
    to = {(p, kinds[p % len(kinds)]): [(p + k) % len(pages) for k in (11, 22)] for p in pages} | {(p, "up"): [p // 2] for p in pages if p}
    expected = set()
    for start in pages:
        for kind, most in links.DEPTHS.items():
            front, seen = {start}, {}
            for depth in range(1, (most or len(pages)) + 1):
                front = {n for f in front for n in to.get((f, kind), [])} - set(seen)
                seen |= dict.fromkeys(front, depth)
            expected |= {(start, kind, n, k) for n, k in seen.items() if n != start}
    got = [tuple(r) for r in registry.queries()["e8_attach_context_documents"](spark, SF).select("start", "type", "node", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == expected and any(s % 10 for s, *_ in got)

"""Secret scans with multipart credential linking.

Three base patterns give spans that are always reported. Weak candidates, which alone prove nothing, are access identifiers (account
names, short key ids), secrets (mixed blobs without a keyword) and endpoints (URLs, host settings, addresses with a port). A scope is
the text between two blank lines. An interval join decides about the candidates: a weak part is reported only where complementary
parts, as intervals, meet its scope (or, with `reach`, what of its scope lies at most so many characters before or after it):

* a weak identifier next to any secret, a weak secret next to any identifier (base spans count as parts),
* an endpoint next to both an identifier and a secret.

Parts that overlap are one string and don't complete each other. The join runs in each task over the sorted part positions of a batch
of documents (binary searches, no pairs), so it needs no shuffle and its memory follows the batch.

Cases: null text counts as empty. Spans are code points, end exclusive. Weak spans that touch a base span are not reported again, and
of weak spans that overlap the first stays. Repeated rows get equal rows; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, per_row, quoted

#: Order of the kinds where spans start at one place.
KINDS = ("assign", "access", "hex", "link_access", "link_secret", "link_endpoint")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK = (
    ("access", re.compile(r"""(?ai)\b(?:user(?:name)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[a-z0-9_.@+-]{3,}|\bA[KSR][IO]A[A-Z0-9]{8,}""")),
    ("secret", re.compile(r"[A-Za-z0-9+/_-]{20,}")),
    ("endpoint", re.compile(r"""(?ai)\bhttps?://[^\s"'<>]+|\b(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[a-z0-9.-]{4,}|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}\b""")),
)
_DIGIT, _CAPITAL = re.compile("[0-9]"), re.compile("[A-Z]")
_BLANK = re.compile(r"\n[ \t\r]*\n")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def weak_spans(part: str, find: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Candidates of one part. Of a run of blob characters, what starts with a letter or digit counts, if it mixes capitals and digits."""
    if part != "secret":
        return [m.span() for m in find.finditer(text)]
    found = []
    for m in find.finditer(text):
        own = m[0].lstrip("+/-")
        if len(own) >= 20 and _DIGIT.search(own) and _CAPITAL.search(own):
            found.append((m.end() - len(own), m.end()))
    return found


def _touching(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """spans: sorted, merged."""
    k = bisect_left(spans, (start, start))
    return (k < len(spans) and spans[k][0] < end) or (k > 0 and spans[k - 1][1] > start)


def linked_spans(text: str, base: list[tuple[int, int, str]], reach: int | None = None) -> list[tuple[int, int, str]]:
    """The weak candidates that complementary parts support."""
    covered: list[tuple[int, int]] = []
    for a, b, _ in base:
        if covered and a <= covered[-1][1]:
            covered[-1] = (covered[-1][0], max(b, covered[-1][1]))
        else:
            covered.append((a, b))
    weak: list[tuple[int, int, str]] = []
    for part, find in WEAK:  # identifiers first: without one, no weak part has its complements
        weak += [(*span, part) for span in weak_spans(part, find, text) if not _touching(covered, *span)]
        if not weak and not any(kind == "access" for _, _, kind in base):
            return []
    if not weak:
        return []
    parts = {"access": [], "secret": [], "endpoint": []}
    for a, b, kind in base:
        parts["access" if kind == "access" else "secret"].append((a, b))
    for a, b, part in weak:
        parts[part].append((a, b))
    cuts = np.array([0, *(m.end() for m in _BLANK.finditer(text)), len(text) + 1])
    starts, ends = (np.array([w[i] for w in weak]) for i in (0, 1))
    scope = np.searchsorted(cuts, starts, "right")
    low, high = cuts[scope - 1], cuts[scope]
    if reach is not None:
        low, high = np.maximum(starts - reach, low), np.minimum(ends + reach, high)
    near = {}
    for part, own in parts.items():
        first, last = (np.sort(np.array([p[i] for p in own], np.int64)) for i in (0, 1))
        # Intervals that start before an end, less those that end before a start: how many meet it.
        meet = lambda a, b: np.searchsorted(first, b, "left") - np.searchsorted(last, a, "right")  # noqa: B023, E731
        near[part] = meet(low, high) > meet(starts, ends)
    needs = {"access": near["secret"], "secret": near["access"], "endpoint": near["access"] & near["secret"]}
    out, last = [], -1
    for k, (a, b, part) in sorted(enumerate(weak), key=lambda x: x[1][:2]):
        if needs[part][k] and a >= last:
            out.append((a, b, f"link_{part}"))
            last = b
    return out


def spans_of(text: str | None, reach: int | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    more = linked_spans(text, base, reach)
    return base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(df: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The columns carry and `found array<struct<start,end,kind>>` of every text."""
    return per_row(df, carry, text, "found array<struct<start:int,end:int,kind:string>>", lambda: lambda t: ([{"start": a, "end": b, "kind": k} for a, b, k in spans_of(t)[1]],))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by mark; other columns stay as they are."""
    def clean(t):
        if t is None:
            return (None,)
        out, last = [], 0
        for a, b, _ in spans_of(t)[1]:
            if a >= last:
                out += [t[last:a], mark]
            last = max(last, b)
        return ("".join([*out, t[last:]]),)

    others = [c for c in docs.columns if c != text]
    (new,) = fresh(docs, "redacted")
    done = per_row(docs, others, text, f"{new} string", lambda: clean)
    return done.select(*(F.col(new).alias(text) if c == text else quoted([c])[0] for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    def make():
        def one(t):
            base, found = spans_of(t)
            n = [sum(s[2] == k for s in base) for k in KINDS[:3]]
            return *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)

        return one

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return per_row(docs, ["doc_id"], "text", "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)

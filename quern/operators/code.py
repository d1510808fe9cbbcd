"""Functions and classes in source code, with where each begins and ends."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# How a definition begins, by language; the last group is its name.
FUNCTIONS = {
    "python": r"^([ \t]*)def\s+(\w+)\s*\([^)]*\):",
    "javascript": r"^([ \t]*)function\s+(\w+)\s*\([^)]*\)\s*{",
    "java": r"^([ \t]*)(public|private|protected)?\s*(static)?\s*\w+\s+(\w+)\s*\([^)]*\)\s*{",
    "cpp": r"^([ \t]*)\w+\s+(\w+)\s*\([^)]*\)\s*{",
    "c": r"^([ \t]*)\w+\s+(\w+)\s*\([^)]*\)\s*{",
}
CLASSES = {
    "python": r"^([ \t]*)class\s+(\w+).*:",
    "javascript": r"^([ \t]*)class\s+(\w+).*{",
    "java": r"^([ \t]*)(public|private)?\s*class\s+(\w+).*{",
    "cpp": r"^([ \t]*)class\s+(\w+).*{",
}
#: Characters that a definition without an end is given.
FALLBACK = 1000
#: What a scanner of braces reads as one: comments, strings (a template string may span lines), and braces.
_TOKENS = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?|([{}])""", re.S)
_LINE = re.compile(r"^[ \t]*(?=[^ \t\n])", re.M)


def brace_ends(code: str) -> tuple[list[int], list[int]]:
    """The places of opening braces outside comments and strings, and for each the place behind its closing one, -1 if there is none."""
    opens: list[int] = []
    ends: list[int] = []
    held: list[int] = []
    for m in _TOKENS.finditer(code):
        if m[1] == "{":
            held.append(len(opens))
            opens.append(m.start())
            ends.append(-1)
        elif m[1] and held:
            ends[held.pop()] = m.end()
    return opens, ends


def indent_ends(code: str, starts: list[int]) -> list[int]:
    """Behind each start, where the next line that is not blank and is indented no deeper begins; -1 if there is none. starts ascend."""
    lines = [(m.start(), len(m.group().expandtabs(8))) for m in _LINE.finditer(code)]
    ends = [-1] * len(starts)
    waiting: list[tuple[int, int]] = []  # (indent, number of the start), ever deeper
    k = 0
    for at, indent in lines:
        while waiting and waiting[-1][0] >= indent:
            ends[waiting.pop()[1]] = at
        while k < len(starts) and starts[k] <= at:
            if starts[k] == at:
                waiting.append((indent, k))
            k += 1
    return ends


def elements(code: str, language: str) -> Iterator[tuple[str, str, int, int]]:
    """(function or class, name, start, end), by start. A definition of a brace language ends with the brace that closes the first one it opens."""
    found = [(m.start(), kind, m.groups()[-1]) for kind, shapes in (("function", FUNCTIONS), ("class", CLASSES)) if language in shapes for m in re.finditer(shapes[language], code, re.M)]
    found.sort()
    if language == "python":
        starts = sorted({at for at, _, _ in found})
        known = dict(zip(starts, indent_ends(code, starts)))
        ends = [known[at] for at, _, _ in found]
    else:
        opens, closes = brace_ends(code)
        ends = [closes[k] if (k := bisect_left(opens, at)) < len(opens) else -1 for at, _, _ in found]
    for (at, kind, name), end in zip(found, ends):
        yield kind, name, at, end if end >= 0 else min(at + FALLBACK, len(code))


def code_elements(df: DataFrame, column: str, language: str) -> DataFrame:
    """doc_id, language, kind, name, start, stop of the definitions in the code of a column; language is a column too. Languages that are not
    known, and null code, have none."""
    key = df.schema["doc_id"].dataType.simpleString()

    def find(batches):
        for batch in batches:
            for doc, code, spoken in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                rows = list(elements(code, spoken)) if code and spoken in FUNCTIONS else []
                for at in range(0, len(rows), 4096):
                    part = rows[at : at + 4096]
                    kind, name, start, stop = zip(*part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc.as_py()] * len(part), batch.column(0).type), pa.array([spoken] * len(part)), pa.array(kind), pa.array(name), pa.array(start, pa.int64()), pa.array(stop, pa.int64())],
                        ["doc_id", "language", "kind", "name", "start", "stop"],
                    )

    return df.select("doc_id", column, language).mapInArrow(find, f"doc_id {key}, language string, kind string, name string, start long, stop long")

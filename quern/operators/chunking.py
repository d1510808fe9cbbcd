"""Cutting documents into chunks, and what is computed over chunk tables.

Every cut is an expression over one row or a window over one document, so no text is shuffled except where lines of a document are
numbered. Order-dependent packing is a fold over the sizes of pieces (`pack`), row by row, and needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import paths as P
from quern.sources.scratch import materialize

_BLANK = r"^\s*$"


def fixed_windows(df: DataFrame, column: str, size: int = 2000, step: int = 1800) -> DataFrame:
    """Windows of `size` characters every `step`; the last one ends with the text; blank windows are left out."""
    n = F.length(column)
    starts = F.sequence(F.lit(0), F.greatest(n - (size - step) - 1, F.lit(0)), F.lit(step))
    # Blank windows go before windows are numbered, so every row numbers its own and no text is shuffled.
    filled = F.filter(starts, lambda at: ~F.substring(F.col(column), at + 1, F.lit(size)).rlike(_BLANK))
    cut = df.select("*", F.posexplode(filled).alias("__index", "start"))
    content = F.substring(F.col(column), F.col("start") + 1, F.lit(size))
    return cut.select("doc_id", F.col("__index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), content.alias("content"), F.least(F.col("start") + size, n).cast("long").alias("stop"), n.cast("long").alias("doc_length"))


def pack(pieces: Column, limit: int, extra: int = 0, carry: int = 0, carry_size: int = 0) -> Column:
    """Greedy packing: array<struct<first,last>> of piece numbers from 1. A group closes before the piece that would take its size, with
    `extra` for each piece, over the limit; the next one starts with the last `carry` pieces, or with as many as reach carry_size. The fold
    sees the sizes only, each once; a piece without a size closes no group."""

    def groups(sizes: list) -> list[tuple[int, int]]:
        sizes = [float("nan") if s is None else s for s in sizes]
        out, first, size = [], 1, 0
        for i, s in enumerate(sizes):
            if size > 0 and size + s > limit:
                out.append((first, i))
                back, size = (0, 0) if carry_size else (min(carry, i - first + 1), sum(sizes[i - min(carry, i - first + 1) : i]))
                while carry_size and size < carry_size and back < i - first + 1:
                    size += sizes[i - back - 1]
                    back += 1
                first = i - back + 1
            size += s
        return [*out, (first, len(sizes))] if sizes else out

    @F.arrow_udf("array<struct<first:int,last:int>>")
    def fold(sizes: pa.Array) -> pa.Array:
        return pa.array([None if own is None else groups(own) for own in sizes.to_pylist()], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))

    return fold(F.transform(pieces, lambda p: F.length(p) + extra))


def _group(pieces: str, g: Column) -> Column:
    """The pieces of a group of `pack`."""
    return F.slice(pieces, g["first"], g["last"] - g["first"] + 1)


def _contents(pieces: str, groups: str, joiner: str) -> Column:
    """Every group joined, made before groups become rows, so that no row carries all pieces."""
    return F.transform(groups, lambda g: F.array_join(_group(pieces, g), joiner))


def packed(df: DataFrame, pieces: Column, joiner: str, **how) -> DataFrame:
    """doc_id, chunk_index, content: the groups of `pack`, joined."""
    got = df.select("doc_id", pieces.alias("p")).select("doc_id", "p", pack(F.col("p"), **how).alias("g"))
    return got.select("doc_id", F.posexplode(_contents("p", "g", joiner)).alias("chunk_index", "content")).withColumn("chunk_index", F.col("chunk_index").cast("long"))


def by_sentence(df: DataFrame, column: str, limit: int = 2000, carry: int = 2) -> DataFrame:
    """Sentences packed to the limit; a chunk starts with the last sentences of the one before."""
    return packed(df, T.sentences(column), " ", limit=limit, extra=1, carry=carry)


def by_sentence_size(df: DataFrame, column: str, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """Sentences packed to the limit; a chunk starts with as many old sentences as reach the overlap."""
    return packed(df, T.sentences(column), " ", limit=limit, carry_size=overlap)


def by_paragraph(df: DataFrame, column: str, limit: int = 2000) -> DataFrame:
    paragraphs = F.filter(F.transform(F.split(F.col(column), "\n\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)
    return packed(df, paragraphs, "\n\n", limit=limit, extra=2)


def by_words(df: DataFrame, column: str, limit: int = 256, carry: int = 6) -> DataFrame:
    """Texts within the limit whole, others by words: packed as by `pack`, in one pass over Arrow batches, as words are many. Chunks leave in
    batches of a bounded number, so a long text costs its own length only."""
    import re

    import pyarrow as pa

    most, schema = 20_000, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, chunk_index long, content string"

    def groups(text: str):
        words = [text] if len(text) <= limit else [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
        sizes = [len(w) + 1 for w in words]
        first, size = 0, 0
        for i, s in enumerate(sizes):
            if size > 0 and size + s > limit:
                yield " ".join(words[first:i])
                first = max(first, i - carry)
                size = sum(sizes[first:i])
            size += s
        if words:
            yield " ".join(words[first:])

    def made(keys, ids, index, content):
        return pa.RecordBatch.from_arrays([keys.take(pa.array(ids)), pa.array(index, pa.int64()), pa.array(content, pa.string())], ["doc_id", "chunk_index", "content"])

    def cut(batches):
        for batch in batches:
            ids, index, content = [], [], []
            for row, text in enumerate(batch.column(1)):
                if not text.is_valid:
                    continue
                for k, chunk in enumerate(groups(text.as_py())):
                    ids.append(row)
                    index.append(k)
                    content.append(chunk)
                    if len(ids) >= most:
                        yield made(batch.column(0), ids, index, content)
                        ids, index, content = [], [], []
            if ids:
                yield made(batch.column(0), ids, index, content)

    return df.select("doc_id", column).mapInArrow(cut, schema)


def by_paragraph_then_sentence(df: DataFrame, column: str, limit: int = 2000) -> DataFrame:
    """Each paragraph a chunk; longer ones by sentences."""
    parts = df.select("doc_id", F.posexplode(F.split(F.col(column), "\n\n")).alias("part", "p")).where(F.length(F.trim("p")) > 0)
    pieces = F.when(F.length("p") <= limit, F.array(F.trim("p"))).otherwise(T.sentences("p"))
    got = parts.select("doc_id", "part", pieces.alias("p")).select("doc_id", "part", "p", pack(F.col("p"), limit, 1).alias("g"))
    got = got.select("doc_id", "part", F.posexplode(_contents("p", "g", " ")).alias("sub", "content"))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("part", "sub")) - 1
    return got.select("doc_id", index.cast("long").alias("chunk_index"), "content")


def by_line_start(df: DataFrame, column: str, starts: str) -> DataFrame:
    """A new chunk at every line that matches; no text is lost."""
    rows = df.select("doc_id", F.posexplode(T.lines(column)).alias("i", "line"))
    section = F.sum(F.col("line").rlike(starts).cast("int")).over(W.partitionBy("doc_id").orderBy("i"))
    groups = rows.withColumn("s", section).groupBy("doc_id", "s").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("content"))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("s")) - 1
    return groups.where(~F.col("content").rlike(_BLANK)).select("doc_id", index.cast("long").alias("chunk_index"), "content")


_HEADING = re.compile(r"\n(?=#{1,6}[ \t\n\r\f]+[^ \t\n\r\f])")
#: Where an oversize Markdown text is cut, in order of preference: what begins there, from which share of the limit on, and whether the cut is
#: behind it.
BREAKS = [(r"\n#+[ \t\n\r\f]+", 0.5, False), (r"\n[ \t\n\r\f]*\n", 0.7, False), (r"\n[-*+][ \t\n\r\f]+", 0.8, False), (r"[.!?][ \t\n\r\f]+", 0.8, True)]


def _broken(text: str, limit: int) -> Iterator[str]:
    """text in pieces: as long as it is over the limit, the lines that take it there are searched for a break."""
    white, breaks = " \t\n\r\f", [(re.compile(shape), int(limit * share), behind) for shape, share, behind in BREAKS]
    while len(text) > limit:
        end = text.find("\n", limit + 1)
        lines = text if end < 0 else text[:end]
        at = int(limit * 0.8)
        for shape, least, behind in breaks:
            # A match begins behind its share, or, if the cut is behind it, ends there.
            found = shape.search(lines, least - 1 if behind else least + 1)
            if found:
                at = found.end() if behind else found.start()
                break
        yield text[:at].strip(white)
        text = text[at:].lstrip(white)
    yield text.strip(white)


def by_heading(df: DataFrame, column: str, limit: int = 2000) -> DataFrame:
    """Markdown sections, each from one heading to the next; those over the limit are broken before a heading, at a blank line, before a list item
    or behind a sentence, in this order, and else at four fifths of the limit. Pieces are trimmed, blank ones left out."""
    key = df.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).to_pylist()):
                pieces = [p for section in _HEADING.split(text or "") for p in _broken(section, limit) if p]
                if pieces:
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(pieces), batch.column(0).type), pa.array(range(len(pieces)), pa.int64()), pa.array(pieces)], ["doc_id", "chunk_index", "content"])

    return df.select("doc_id", column).mapInArrow(cut, f"doc_id {key}, chunk_index long, content string")


def by_definition(df: DataFrame, column: str) -> DataFrame:
    return by_line_start(df, column, r"^\s*(?:async\s+def|def|class|function|public|private|protected)\s+\w")


def _cut_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most `size`, cut at the first separator that occurs; pieces still too long are cut at the next ones."""
    if len(text) <= size:
        return [text] if text.strip() else []
    k = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator, rest = separators[k], separators[k + 1 :]
    if not separator:
        return [text[i : i + size] for i in range(0, max(len(text) - overlap, 1), size - overlap)]
    out: list[str] = []
    held: list[str] = []
    length = 0
    for piece in text.split(separator):
        if len(piece) > size:
            if held:
                out.append(separator.join(held))
            held, length = [], 0
            out += _cut_recursively(piece, size, overlap, rest or ("",))
            continue
        if held and length + len(piece) + len(separator) > size:
            out.append(separator.join(held))
            while held and (length > overlap or length + len(piece) + len(separator) > size):
                length -= len(held.pop(0)) + len(separator)
        held.append(piece)
        length += len(piece) + len(separator)
    if held:
        out.append(separator.join(held))
    return [x.strip() for x in out if x.strip()]


def recursive(df: DataFrame, column: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """Recursive cutting at blank lines, lines, sentences, spaces, characters; chunk_id is a hash, not a running number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, i, c, len(c)) for d, t in zip(f["doc_id"], f["t"]) for i, c in enumerate(_cut_recursively(t or "", size, overlap, ("\n\n", "\n", ". ", " ", "")))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "content", "char_count"])

    out = df.select("doc_id", F.col(column).alias("t")).mapInPandas(run, "doc_id long, chunk_index long, content string, char_count long")
    return out.withColumn("chunk_id", F.sha2(F.concat_ws(":", "doc_id", "chunk_index"), 256))


# ---- structure ----------------------------------------------------------------------------------------------------------


def sections(df: DataFrame, column: str) -> DataFrame:
    """doc_id, sec, level, title, start, stop (next heading or end), parent (nearest earlier section of a smaller level)."""
    rows = df.select("doc_id", F.length(column).alias("n"), F.posexplode(T.lines(column)).alias("i", "line"))
    by_doc = W.partitionBy("doc_id").orderBy("i")
    placed = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(by_doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    heads = placed.where(F.col("line").rlike(r"^#{1,6}[ \t]+\S"))
    level = F.length(F.regexp_extract("line", "^(#+)", 1))
    found = heads.select("doc_id", "n", F.row_number().over(by_doc).alias("sec"), level.alias("level"), F.trim(F.regexp_extract("line", r"^#+[ \t]+(.*)$", 1)).alias("title"), "start")
    found = found.withColumn("stop", F.coalesce(F.lead("start").over(W.partitionBy("doc_id").orderBy("sec")), F.col("n")))
    # The nearest earlier section of each level, then the latest of those with a smaller level.
    before = W.partitionBy("doc_id").orderBy("sec").rowsBetween(W.unboundedPreceding, -1)
    latest = [F.max(F.when(F.col("level") == k, F.col("sec"))).over(before) for k in range(1, 6)]
    parent = F.array_max(F.array(*[F.when(F.col("level") > k, x) for k, x in enumerate(latest, 1)]))
    return found.select("doc_id", F.col("sec").cast("long").alias("sec"), F.col("level").cast("long").alias("level"), "title", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), parent.cast("long").alias("parent"))


def _marks(body: str) -> tuple[Column, Column, Column]:
    """Whether a text holds code, a table, a list."""
    return F.contains(body, F.lit("```")), F.col(body).rlike(r"(?m)^\|.*\|$"), F.col(body).rlike(r"(?m)^\s*(?:[-*+]|[0-9]+\.)\s+\S")


def _holds(body: str) -> Column:
    code, table, items = _marks(body)
    return F.when(table, "table").when(code, "code").when(items, "list").otherwise("text")


def section_flags(df: DataFrame, column: str) -> DataFrame:
    """What each section holds: code, table, list, and its kind and counts."""
    full = sections(df, column).join(df.select("doc_id", F.col(column).alias("__t")), "doc_id")
    body = full.select("doc_id", "sec", F.substring(F.col("__t"), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("body"))
    code, table, items = _marks("body")
    return body.select("doc_id", "sec", code.alias("has_code"), table.alias("has_table"), items.alias("has_list"), _holds("body").alias("kind"), T.word_count("body").alias("n_words"), F.size(T.lines("body")).cast("long").alias("n_lines"))


def elements(df: DataFrame, column: str, bodies: bool = False) -> DataFrame:
    """Runs of lines of one kind: header, code (a whole fence), list, table, quote, text; with offsets. Blank lines end a run. bodies: with
    their text, so that no text must be joined back."""
    rows = df.select("doc_id", F.posexplode(T.lines(column)).alias("i", "line"))
    by_doc = W.partitionBy("doc_id").orderBy("i")
    upto = by_doc.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(by_doc.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("marks", F.sum(F.startswith("line", F.lit("```")).cast("int")).over(upto))
    fence = F.startswith("line", F.lit("```"))
    inside = (F.col("marks") % 2 == 1) | fence
    kind = (
        F.when(inside, "code").when(F.col("line").rlike(r"^#{1,6}\s+\S"), "header").when(F.col("line").rlike(r"^\s*(?:[-*+]|[0-9]+\.)\s+\S"), "list")
        .when(F.col("line").rlike(r"^\s*\|.*\|\s*$"), "table").when(F.startswith("line", F.lit(">")), "quote").when(F.trim("line") == "", "blank").otherwise("text")
    )
    rows = rows.withColumn("kind", kind)
    opens = (fence & (F.col("marks") % 2 == 1)) | (F.col("kind") == "header")
    change = F.coalesce((F.lag("kind").over(by_doc) != F.col("kind")) | opens, F.lit(True))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    body = [text.alias("body")] if bodies else []
    runs = rows.withColumn("run", F.sum(change.cast("int")).over(upto)).groupBy("doc_id", "run", "kind").agg(F.min("start").alias("start"), F.max(F.col("start") + F.length("line")).alias("stop"), F.count("*").alias("n_lines"), *body)
    return runs.where("kind <> 'blank'").select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("run")).cast("long").alias("element"), "kind", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "n_lines", *(["body"] if bodies else []))


def recut(chunks: DataFrame, limit: int, pieces: Column, target: int, sep: str) -> DataFrame:
    """Chunks over `limit` characters are cut into their pieces, packed to `target`; `whole` tells which were not. Keeps all columns."""
    over = F.length("content") > limit
    rows = chunks.withColumns({"whole": ~over, "p": F.when(over, pieces).otherwise(F.array("content"))})
    rows = rows.withColumn("g", pack(F.col("p"), target + len(sep), len(sep)))
    kept = [c for c in chunks.columns if c != "content"]
    sub = rows.select(*kept, "whole", F.posexplode(_contents("p", "g", sep)).alias("sub", "content")).where(~F.col("content").rlike(_BLANK))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index", "sub")) - 1
    return sub.withColumn("chunk_index", index.cast("long")).drop("sub")


def merge_next(chunks: DataFrame, least: int, same: list[str], sums: list[str], never: Column | None = None) -> DataFrame:
    """A whole chunk under `least` characters is joined with the next one, if both are equal in the columns `same`; what was joined is not
    joined again. Down a run of such chunks every second one is taken by the one before, so a count within runs decides, not a fold."""
    by_doc = W.partitionBy("doc_id").orderBy("chunk_index")
    short = F.col("whole") & (F.length("content") < least) & F.lead("chunk_index").over(by_doc).isNotNull()
    for c in same:
        short = short & F.lead(c).over(by_doc).eqNullSafe(F.col(c))
    rows = chunks.withColumn("short", short if never is None else short & ~never)
    rows = rows.withColumn("run", F.sum((~F.col("short")).cast("int")).over(by_doc))
    place = F.row_number().over(W.partitionBy("doc_id", "run", "short").orderBy("chunk_index"))
    rows = rows.withColumn("takes", F.col("short") & (place % 2 == 1))
    rows = rows.withColumn("group", F.sum((~F.coalesce(F.lag("takes").over(by_doc), F.lit(False))).cast("int")).over(by_doc))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n")  # two at most
    out = rows.groupBy("doc_id", "group").agg(text.alias("content"), F.count("*").alias("merged"), *[F.first(c).alias(c) for c in same], *[F.sum(c).alias(c) for c in sums])
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("group")) - 1
    return out.withColumn("chunk_index", index.cast("long")).drop("group")


def structural(df: DataFrame, column: str, limit: int = 2000, target: int = 1500, least: int = 200) -> DataFrame:
    """Elements packed to the limit; a header starts a chunk. What is still over the limit is cut at blank lines and packed to the target;
    a chunk under `least` is joined with the next of its kind and section, but code never is."""
    parts = elements(df, column, True).select("doc_id", "element", "kind", "body")
    parts = parts.withColumn("head", F.sum((F.col("kind") == "header").cast("int")).over(W.partitionBy("doc_id").orderBy("element")))
    lists = parts.groupBy("doc_id", "head").agg(F.array_sort(F.collect_list(F.struct("element", "kind", "body"))).alias("e"))
    got = lists.withColumn("g", pack(F.transform("e", lambda x: x["body"]), limit, 2))
    got = got.select("doc_id", "head", F.posexplode(F.transform("g", lambda g: _group("e", g))).alias("sub", "own"))
    own = F.col("own")
    kinds = F.array_distinct(F.transform(own, lambda x: x["kind"]))
    kind = F.when(F.array_contains(kinds, "code"), "code").when(F.array_contains(kinds, "table"), "table").when(F.array_contains(kinds, "list"), "list").when(F.array_contains(kinds, "header"), "section").otherwise("mixed")
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("head", "sub")) - 1
    packed = got.select("doc_id", "head", index.cast("long").alias("chunk_index"), kind.alias("kind"), F.array_join(F.transform(own, lambda x: x["body"]), "\n\n").alias("content"))
    cut = recut(packed, limit, F.split("content", "\n\n"), target, "\n\n")
    return merge_next(cut, least, ["kind", "head"], [], F.col("kind") == "code").select("doc_id", "chunk_index", "kind", "content", "merged")


# Words that open a sentence of another turn and what they count for, words without a topic, words that tell of a new topic, and
# what starts a list.
TRANSITIONS = {
    "contrast": ["however", "nevertheless", "on the other hand", "in contrast", "but", "yet"],
    "addition": ["furthermore", "moreover", "additionally", "also", "besides"],
    "sequence": ["first", "second", "third", "next", "then", "finally", "subsequently"],
    "causation": ["therefore", "thus", "consequently", "as a result", "hence"],
    "temporal": ["meanwhile", "simultaneously", "previously", "afterwards", "later"],
}
TRANSITION_STRENGTH = {"contrast": 0.9, "causation": 0.8, "sequence": 0.7, "temporal": 0.6, "addition": 0.4}
CLOSINGS, CLOSING_STRENGTH = ["in summary", "to conclude", "in conclusion"], 0.9
TOPIC_STOP_WORDS = [
    "the", "and", "are", "for", "not", "but", "have", "this", "that", "with", "from", "they", "she", "her", "his", "him", "you", "your",
    "can", "will", "was", "were", "been", "said", "each", "which", "what", "when", "where", "who", "why", "how", "all", "any", "may",
    "use", "way", "about", "many", "then", "them", "would", "like", "into", "time", "has", "two", "more", "very", "after", "words",
    "first", "came", "work", "must", "through", "back", "years",
]
TOPIC_MARKS = ["however", "therefore", "moreover", "furthermore", "nevertheless", "in contrast", "on the other hand", "meanwhile", "finally", "first", "second", "third", "next", "then", "additionally", "also"]
LIST_STARTS = ["- ", "* ", "1. ", "2. ", "3. "]
#: The order in which boundaries of one place come.
KINDS = ["paragraph", "sentence", "topic_shift"]
_OPENINGS = (*(w + mark for words in TRANSITIONS.values() for w in words for mark in " ,"), *CLOSINGS)
_SPACE = " \t\n\r\f"
_SENTENCE_END, _PARAGRAPH_END, _RUN = re.compile(rf"[.!?]+[{_SPACE}]+"), re.compile(rf"\n[{_SPACE}]*\n"), re.compile(r"\w+")


def _shifts(text: str, window: int, step: int, alike: float, reach: int):
    """(position, 1 - similarity) where the words of a window and of the next one, `step` characters on, are not alike; moved to the nearest end
    of a sentence within `reach`. The words of a window are counted as it slides: each word comes in once and goes out once."""
    stop = set(TOPIC_STOP_WORDS)
    topical = lambda w: w if len(w) > 2 and w.isascii() and w.isalpha() and w not in stop else None
    runs = [(m.start(), m.end(), topical(m.group().lower())) for m in _RUN.finditer(text)]
    counts: dict = {}  # of topical words only
    low = high = 0  # runs from low to high lie inside the window
    before = None
    for at in range(0, len(text) - window, step):
        to = at + window
        while high < len(runs) and runs[high][1] <= to:
            word = runs[high][2]
            if word:
                counts[word] = counts.get(word, 0) + 1
            high += 1
        while low < high and runs[low][0] < at:
            word = runs[low][2]
            if word:
                counts[word] -= 1
                if not counts[word]:
                    del counts[word]
            low += 1
        words = set(counts)
        for a, b, _ in (*runs[max(low - 1, 0) : low], *runs[high : high + 1]):  # words that an edge of the window cuts
            if a < to and b > at and (word := topical(text[max(a, at) : min(b, to)].lower())):
                words.add(word)
        if before is not None:
            both = len(before & words)
            similarity = both / (len(before) + len(words) - both) if before and words else 0.0
            if similarity < alike:
                near = [(abs(m.end() - at), m.end()) for m in _SENTENCE_END.finditer(text, max(0, at - reach), min(len(text), at + reach))]
                place = min(near, key=lambda x: x[0])[1] if near else at
                if place > 0:
                    yield place, 1.0 - similarity
        before = words


def _turns(text: str):
    """(position, strength, sentence, next sentence) where a sentence begins with a transition; the position is the end of the one before."""
    cuts = list(_SENTENCE_END.finditer(text))
    for k, m in enumerate(cuts):
        start, to = cuts[k - 1].end() if k else 0, cuts[k + 1].start() if k + 1 < len(cuts) else len(text)
        following = text[m.end() : to].strip(_SPACE)
        lead = following.lower()
        if not lead.startswith(_OPENINGS):
            continue
        strength = next((TRANSITION_STRENGTH[kind] for kind, words in TRANSITIONS.items() if any(lead.startswith((w + " ", w + ",")) for w in words)), CLOSING_STRENGTH if lead.startswith(tuple(CLOSINGS)) else 0.0)
        if strength:
            yield m.start(), strength, text[start : m.start()], following


def _bounds(text: str | None, kinds: tuple, window: int = 200, step: int = 50, alike: float = 0.75, reach: int = 50, side: int = 50) -> list[tuple]:
    """(position, kind, strength, before, after) of one text."""
    text, rows = text or "", []
    if "paragraph" in kinds:
        for p in (m.end() for m in _PARAGRAPH_END.finditer(text)):
            rows.append((p, "paragraph", 0.7, text[max(0, p - 100) : p].strip(_SPACE)[-side:], text[p : p + 100].strip(_SPACE)[:side]))
    if "sentence" in kinds:
        rows += [(p, "sentence", s, a[-side:], b[:side]) for p, s, a, b in _turns(text)]
    if "topic_shift" in kinds:
        rows += [(p, "topic_shift", s, text[max(0, p - side) : p], text[p : p + side]) for p, s in _shifts(text, window, step, alike, reach)]
    return rows


def _thinned(rows: list[tuple], apart: int) -> list[tuple]:
    """Boundaries closer than `apart` to the last one kept collapse to the stronger, in order; of one place paragraphs come first, then
    sentences, then shifts."""
    kept: list[tuple] = []
    for b in sorted(rows, key=lambda b: (b[0], KINDS.index(b[1]), *b[2:])):
        if not kept or b[0] - kept[-1][0] >= apart:
            kept.append(b)
        elif b[2] > kept[-1][2]:
            kept[-1] = b
    return kept


_BOUND = pa.struct([("position", pa.int64()), ("kind", pa.string()), ("strength", pa.float64()), ("before", pa.string()), ("after", pa.string())])
_BOUND_SQL = "struct<position:bigint,kind:string,strength:double,before:string,after:string>"


def boundaries(df: DataFrame, column: str, kinds: tuple = tuple(KINDS), apart: int = 0, **how) -> DataFrame:
    """doc_id, position, kind, strength, before, after: paragraph breaks, sentences that begin with a transition, and shifts of topic, with up to
    `side` characters on both sides. White space is that of ASCII; words are runs of letters, digits and underscores. Null texts have none.
    apart: thinned as by `thin`, text by text, where they are found."""
    key = df.schema["doc_id"].dataType.simpleString()

    def made(keys, ids, rows):
        for at in range(0, len(rows), 4096):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 4096]), _BOUND)]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(ids[at : at + 4096])), *columns], ["doc_id", *(f.name for f in _BOUND)])

    def find(batches):
        for batch in batches:
            ids, rows = [], []
            for k, text in enumerate(batch.column(1)):
                own = _bounds(text.as_py(), kinds, **how)
                own = _thinned(own, apart) if apart else own
                rows += own
                ids += [k] * len(own)
                if len(rows) >= 4096:
                    yield from made(batch.column(0), ids, rows)
                    ids, rows = [], []
            yield from made(batch.column(0), ids, rows)

    return df.select("doc_id", column).mapInArrow(find, f"doc_id {key}, position long, kind string, strength double, before string, after string")


def thin(bounds: DataFrame, apart: int = 50) -> DataFrame:
    """`_thinned` for a table of boundaries that is there already: a fold over each document's boundaries."""
    lists = bounds.groupBy("doc_id").agg(F.collect_list(F.struct(*(f.name for f in _BOUND))).alias("b"))

    @F.arrow_udf(f"array<{_BOUND_SQL}>")
    def fold(b: pa.Array) -> pa.Array:
        return pa.array([_thinned([tuple(x.values()) for x in own], apart) for own in b.to_pylist()], pa.list_(_BOUND))

    return lists.select("doc_id", F.inline(fold("b")))


def _strength(strength: Column, kind: Column, before: Column, after: Column) -> Column:
    """A strength that follows what stands on both sides: +0.2 after a colon, +0.15 before a list, half between quotation marks, +0.1 for a
    paragraph with a topic word near; 1 at most, in this order."""
    plus = lambda s, when, x: F.when(when, F.least(F.lit(1.0), s + x)).otherwise(s)
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    s = plus(strength, F.endswith(strip(before), F.lit(":")), 0.2)
    s = plus(s, strip(after).rlike(rf"\A(?:{'|'.join(map(re.escape, LIST_STARTS))})"), 0.15)
    s = F.when(F.contains(before, F.lit('"')) & F.contains(after, F.lit('"')), s * 0.5).otherwise(s)
    s = plus(s, (kind == "paragraph") & after.rlike(rf"(?i)\b(?:{'|'.join(TOPIC_MARKS)})\b"), 0.1)
    return F.round(s, 6)


def adjusted(bounds: DataFrame) -> DataFrame:
    """bounds with strengths that follow what stands on both sides."""
    return bounds.select("doc_id", "position", _strength(*(F.col(c) for c in ("strength", "kind", "before", "after"))).alias("strength"), "kind")


_WHITE = " \t\n\x0b\f\r"


def _cut_at(text: str, cuts: list[int]) -> list[str]:
    """The pieces between cuts, trimmed. A cut within a word of less than 200 characters moves to the word's start: a shift of topic without an
    end of a sentence near may lie anywhere."""
    marks = {0, len(text)}
    for at in cuts:
        start = at
        while at < len(text) and text[at] not in _WHITE and start and text[start - 1] not in _WHITE and at - start < 200:
            start -= 1
        marks.add(start if at - start < 200 else at)
    places = sorted(marks)
    return [text[a:b].strip(_WHITE) for a, b in zip(places, places[1:])]


def semantic(df: DataFrame, column: str, least: float = 0.5, limit: int = 2000, short: int = 200, dropped: int = 100) -> DataFrame:
    """Cut at thinned and adjusted boundaries of some strength, never within a word; chunks over the limit are cut by sentences, and one under `short` is joined
    with the next. No text is lost: n_short counts the pieces under `dropped` characters that a chunk holds. Texts are cut where they are read."""

    @F.arrow_udf(f"array<{_BOUND_SQL}>")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([_thinned(_bounds(t.as_py(), tuple(KINDS)), 50) for t in texts], pa.list_(_BOUND))

    @F.arrow_udf("array<string>")
    def pieces(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array([_cut_at(t.as_py() or "", at) for t, at in zip(texts, cuts.to_pylist())], pa.list_(pa.string()))

    full = df.select("doc_id", F.col(column).alias("t"), found(F.col(column)).alias("b"))
    strong = F.filter("b", lambda b: _strength(b["strength"], b["kind"], b["before"], b["after"]) >= least)
    full = full.select("doc_id", "t", F.transform(strong, lambda b: b["position"]).alias("cuts"))
    got = full.select("doc_id", F.posexplode(pieces("t", "cuts")).alias("chunk_index", "content")).where("content <> ''")
    cut = recut(got, limit, F.split("content", r"(?<=[.!?])\s+"), limit, " ").withColumn("n_short", (F.length("content") < dropped).cast("long"))
    return merge_next(cut, short, [], ["n_short"]).select("doc_id", "chunk_index", "content", "merged", "n_short")


def _within(parts: DataFrame, key: list[str], strategy, **how) -> DataFrame:
    """A strategy over parts of documents (key, content): key, sub, content, and kind if the strategy gives one."""
    name = F.concat_ws("#", *key)
    got = strategy(parts.select(name.alias("doc_id"), F.col("content").alias("t")), "t", **how)
    kind = F.col("kind") if "kind" in got.columns else F.lit("semantic").alias("kind")
    ids = F.split("doc_id", "#")
    return got.select(*(F.element_at(ids, i + 1).cast("long").alias(k) for i, k in enumerate(key)), F.col("chunk_index").alias("sub"), kind, "content")


def hybrid(df: DataFrame, column: str, limit: int = 2000) -> DataFrame:
    """Structural chunks; those over the limit are cut again semantically."""
    first = materialize(structural(df, column, limit), "structural")
    long = F.length("content") > limit
    again = _within(first.where(long), ["doc_id", "chunk_index"], semantic, limit=limit)
    every = first.where(~long).select("doc_id", "chunk_index", F.lit(0).cast("long").alias("sub"), "kind", "content").union(again.select("doc_id", "chunk_index", "sub", "kind", "content"))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index", "sub")) - 1
    return every.select("doc_id", index.cast("long").alias("index"), "kind", "content").withColumnRenamed("index", "chunk_index")


def _by_heading(text: str | None) -> list[str]:
    """What stands before the first heading, and each section with its heading, as `sections` finds them."""
    starts = [m.start() for m in re.finditer(r"(?m)^#{1,6}[ \t]+[^ \t\n\x0b\f\r]", text or "")]
    return [(text or "")[a:b] for a, b in zip([0, *starts], [*starts, None])]


def adaptive(df: DataFrame, column: str, long: int = 3000) -> DataFrame:
    """By section: code structurally, tables whole, text over `long` characters semantically, the rest structurally. What stands before the
    first heading is section 0."""
    cut = F.udf(lambda text: _by_heading(text), "array<string>")
    # A text is cut where it is read, and its sections are written once for all three ways.
    parts = df.where("doc_id is not null").select("doc_id", F.posexplode(cut(column)).alias("sec", "content")).withColumn("sec", F.col("sec").cast("long"))
    parts = materialize(parts.where(~F.col("content").rlike(_BLANK)).withColumn("holds", _holds("content")), "parts")
    table, far = F.col("holds") == "table", (F.col("holds") != "code") & (F.length("content") > long)
    whole = parts.where(table).select("doc_id", "sec", F.lit(0).cast("long").alias("sub"), F.lit("table").alias("kind"), "content")
    every = whole.union(_within(parts.where(~table & far), ["doc_id", "sec"], semantic)).union(_within(parts.where(~table & ~far), ["doc_id", "sec"], structural))
    index = F.row_number().over(W.partitionBy("doc_id").orderBy("sec", "sub")) - 1
    return every.select("doc_id", index.cast("long").alias("chunk_index"), "sec", "kind", "content")


# What tells of code in a text in lower case; the last one is written as it is looked for, and so never found.
CODE_INDICATORS = ["def ", "function ", "class ", "import ", "from ", "public class", "private ", "void ", "int main", "#include", "using namespace", "<?php", "<!DOCTYPE"]


def content_kind(text: str, path: Column | None = None) -> Column:
    """markdown, structured_text, code, mixed or text: by the ending of the path if it says so, else by what the text holds."""
    t, low, n = F.col(text), F.lower(text), F.greatest(F.length(text), F.lit(1))
    i = lambda c: c.cast("int")
    marks = 3 * i(t.rlike(r"(?m)^#{1,6}\s+")) + 2 * i(F.contains(t, F.lit("```"))) + i(t.rlike(r"\[.*\]\(.*\)")) + i(t.rlike(r"(?m)^\s*[-*+]\s+")) + i(t.rlike(r"(?m)^\|.*\|$"))
    code = sum((i(F.contains(low, F.lit(x))) for x in CODE_INDICATORS), F.lit(0))
    blank_lines = (F.length(t) - F.length(F.replace(t, F.lit("\n\n"), F.lit("")))) / 2
    found = (
        F.when(marks >= 3, "markdown").when((code >= 2) | (F.regexp_count(t, F.lit("[{}]")) / n > 0.01) | (F.regexp_count(t, F.lit(";")) / n > 0.005), "code")
        .when(blank_lines > F.length(t) / 200, "structured_text").when((marks > 0) & (code > 0), "mixed").otherwise("text")
    )
    if path is None:
        return found
    end = P.ending(path)
    return F.when(end.isin("md", "markdown"), "markdown").when(end == "rst", "structured_text").when(end.isin(*P.ANALYSED_AS_CODE), "code").otherwise(found)


def chosen_strategy(text: str, path: Column | None = None) -> Column:
    """hybrid for Markdown, structural for code and for texts with fences, semantic for paragraphs of over 500 words on average, else hybrid."""
    kind = content_kind(text, path)
    mean = T.word_count(text) / F.size(F.split(text, r"\n\s*\n"))
    return F.when(kind == "markdown", "hybrid").when((kind == "code") | F.contains(text, F.lit("```")), "structural").when(mean > 500, "semantic").otherwise("hybrid")


def document_chunks(df: DataFrame, column: str, path: Column | None = None, least: int = 200) -> DataFrame:
    """The whole way from documents to a chunk table: every document is analysed, cut by the strategy that suits it, its short chunks joined,
    overlaps taken from the chunk before, ids, neighbours and scores added, and repeated chunks left out. Blank documents have no chunks."""
    routed = df.where(~F.col(column).rlike(_BLANK)).select("doc_id", column, chosen_strategy(column, path).alias("__strategy"))
    routed = materialize(routed, "routed")  # each text is made and analysed once, for all strategies
    parts = []
    for strategy in ("hybrid", "structural", "semantic"):
        cut = merge_short(chunk(routed.where(F.col("__strategy") == strategy).drop("__strategy"), column, strategy).select("doc_id", "chunk_index", "content"), least)
        by_doc = W.partitionBy("doc_id")
        before = by_doc.orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
        n = F.length("content")
        placed = cut.withColumns({"start": F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long"), "doc_length": F.sum(n).over(by_doc).cast("long")})
        parts.append(deduped(scored(enriched(with_overlap(placed)))).withColumn("strategy", F.lit(strategy)))
    return reduce(DataFrame.unionByName, parts)


STRATEGIES = {"sentence": by_sentence, "paragraph": by_paragraph, "words": by_words, "heading": by_heading, "definition": by_definition, "recursive": recursive, "semantic": semantic, "structural": structural, "hybrid": hybrid, "adaptive": adaptive, "fixed": fixed_windows}


def chunk(df: DataFrame, column: str, strategy: str = "hybrid", **how) -> DataFrame:
    """Dispatch by name: doc_id, chunk_index, content, and what else the strategy gives."""
    return STRATEGIES[strategy](df, column, **how)


# ---- chunk tables -----------------------------------------------------------------------------------------------------


def merge_short(chunks: DataFrame, least: int = 200) -> DataFrame:
    """Runs of neighbouring chunks under `least` characters become one, joined by a blank line."""
    by_doc = W.partitionBy("doc_id").orderBy("chunk_index")
    short = F.length("content") < least
    step = F.coalesce((~short | ~F.lag(short).over(by_doc)).cast("int"), F.lit(1))
    runs = chunks.withColumn("run", F.sum(step).over(by_doc)).groupBy("doc_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n").alias("content"), F.count("*").alias("merged"))
    return runs.select("doc_id", (F.row_number().over(W.partitionBy("doc_id").orderBy("run")) - 1).cast("long").alias("chunk_index"), "content", "merged")


def with_overlap(chunks: DataFrame, ratio: float = 0.1, low: int = 100, high: int = 300) -> DataFrame:
    """Each chunk starts with the tail of the one before, as it was without overlap of its own."""
    by_doc = W.partitionBy("doc_id").orderBy("chunk_index")
    before = F.lag("content").over(by_doc)
    n = F.least(F.greatest(F.floor(ratio * F.least(F.length(before), F.length("content"))).cast("int"), F.lit(low)), F.lit(high), F.length(before))
    tail = F.regexp_replace(F.substring(before, F.length(before) - n + 1, n), r"^\S*\s+", "")
    return chunks.withColumn("overlap", F.coalesce(tail, F.lit(""))).withColumn("overlap_size", F.length("overlap").cast("long"))


def adjacent_repeat(chunks: DataFrame, most: int = 200, least: int = 50) -> DataFrame:
    """How many characters the end of a chunk and the start of the next share, where over `least`. Only the `most` characters at both ends move on."""
    n = F.length("content")
    ends = chunks.select("doc_id", "chunk_index", F.substring("content", 1, most).alias("head"), F.substring(F.col("content"), F.greatest(n - most, F.lit(0)) + 1, F.lit(most)).alias("tail"))
    before = F.lag("tail").over(W.partitionBy("doc_id").orderBy("chunk_index"))
    rows = ends.select("doc_id", "chunk_index", "head", before.alias("before")).where("before is not null")

    @F.arrow_udf("long")
    def shared(heads: pa.Array, tails: pa.Array) -> pa.Array:
        pairs = ((h.as_py(), t.as_py()) for h, t in zip(heads, tails))
        return pa.array([next((k for k in range(min(len(h), len(t)), 0, -1) if t.endswith(h[:k])), 0) for h, t in pairs], pa.int64())

    rows = rows.select("doc_id", "chunk_index", F.when(F.col("head").isNull(), 0).otherwise(shared(F.coalesce("head", F.lit("")), "before")).alias("shared"))
    return rows.withColumn("dropped", F.when(F.col("shared") > least, F.col("shared")).otherwise(0).cast("long"))


def coherence(c) -> Column:
    """1 for a single sentence, 0.6 for a cut one, else 0.7 and 0.15 for a capital start and a proper end."""
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    ends, starts = t.rlike(r"[.!?:;]$"), t.rlike(r"^\p{Lu}")
    return F.round(F.when(F.size(F.split(c, r"\. ")) < 2, 1.0).when(~ends, 0.6).otherwise(F.least(F.lit(1.0), 0.85 + F.when(starts, 0.15).otherwise(0.0))), 4)


def completeness(c) -> Column:
    """0.5, and 0.2 for a list that is not cut, 0.3 for closed fences, -0.2 for an open one."""
    items = F.col(c).rlike(r"(?m)^\s*[-*+] ") & (F.contains(c, F.lit("- ")) | F.contains(c, F.lit("* "))) & ~F.endswith(c, F.lit("..."))
    fences = F.regexp_count(c, F.lit("```"))
    score = 0.5 + F.when(items, 0.2).otherwise(0.0) + F.when(fences == 0, 0.0).when(fences % 2 == 0, 0.3).otherwise(-0.2)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 4)


def density(c) -> Column:
    """Mean of the word share (saturating) and the share of distinct words."""
    w = F.filter(T.words(c), lambda x: (F.length(x) > 2) & ~x.rlike("^[0-9]+$"))
    n = F.size(w)
    return F.round(F.when(n == 0, 0.0).otherwise((F.least(F.lit(1.0), n * 1000.0 / F.greatest(F.length(F.trim(c)), F.lit(1))) + F.size(F.array_distinct(w)) / n) / 2), 4)


def scored(chunks: DataFrame) -> DataFrame:
    out = chunks.withColumns({"coherence": coherence("content"), "completeness": completeness("content"), "density": density("content")})
    return out.withColumn("quality", F.round(0.4 * F.col("coherence") + 0.3 * F.col("completeness") + 0.3 * F.col("density"), 6))


def enriched(chunks: DataFrame) -> DataFrame:
    """chunk_id, hash, place in the document, ids of the neighbours."""
    by_doc = W.partitionBy("doc_id").orderBy("chunk_index")
    name = F.concat_ws("_", F.col("doc_id").cast("string"), F.lpad(F.col("chunk_index").cast("string"), 4, "0"))
    out = chunks.withColumns({"chunk_id": name, "hash": F.md5("content"), "position": F.round(F.col("start") / F.greatest(F.col("doc_length"), F.lit(1)), 6)})
    return out.withColumns({"previous_id": F.lag("chunk_id").over(by_doc), "next_id": F.lead("chunk_id").over(by_doc)})


def with_section(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """chunks with section_title and section_level of the section that their start lies in; null and 0 before the first heading."""
    own = section_of(chunks, found).select("doc_id", "chunk_index", F.col("title").alias("section_title"), F.col("level").alias("section_level"))
    return chunks.join(own, ["doc_id", "chunk_index"], "left").withColumn("section_level", F.coalesce("section_level", F.lit(0)).cast("long"))


# What the kind of a chunk adds to its score for a context.
KIND_BONUS = {"header": 0.3, "section": 0.2, "code": 0.1, "table": 0.05, "list": 0.05}


def held_kind(column: str) -> Column:
    """code, table, list or section: the first of these that a chunk holds."""
    c = F.col(column)
    return F.when(F.contains(c, F.lit("```")), "code").when(F.contains(c, F.lit(" | ")), "table").when(c.rlike(r"(?m)^\s*(?:[-*+]|[0-9]+\.)\s+\S"), "list").otherwise("section")


def context_score(query: str) -> Column:
    """What a chunk (content, quality, position, section_level, kind) is worth in the context of a query: 0.4 of its quality, 0.1 for standing early, the
    level of its section over 6 (0.2 at most), a bonus for its kind, and 0.3 for the share of the query's words that it holds; 1 at most."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    bonus = F.coalesce(F.create_map(*[F.lit(x) for p in KIND_BONUS.items() for x in p])[F.col("kind")], F.lit(0.0))
    asked = words(query)
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words("content"))) / F.size(asked)).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.4 * F.col("quality") + 0.1 * (1 - F.col("position")) + F.least(F.col("section_level") / 6, F.lit(0.2)) + bonus + 0.3 * share), 8)


def deduped(chunks: DataFrame) -> DataFrame:
    """The first chunk of each content within a document."""
    first = F.row_number().over(W.partitionBy("doc_id", F.md5("content")).orderBy("chunk_index"))
    return chunks.withColumn("__r", first).where("__r = 1").drop("__r")


def capped(chunks: DataFrame, most: int, score: str) -> DataFrame:
    """The best `most` chunks of a document, in text order, numbered anew."""
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(score), "chunk_index"))
    kept = chunks.withColumn("__r", best).where(F.col("__r") <= most).drop("__r")
    return kept.withColumn("new_index", (F.row_number().over(W.partitionBy("doc_id").orderBy("chunk_index")) - 1).cast("long"))


def importance(quality: Column, position: Column, size: Column) -> Column:
    score = 0.4 * quality + F.when(position < 0.1, 0.2).when(position > 0.9, 0.1).otherwise(0.0) + F.when(size.between(500, 2000), 0.1).when((size < 200) | (size > 3000), -0.1).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 8)


def keywords(column: str, k: int = 10) -> Column:
    """array<struct<word,n>>: the k most frequent words of four letters or more outside a stop list; ties by first place."""
    stop = frozenset(T.KEYWORD_STOP_WORDS)

    @F.arrow_udf("array<struct<word:string,n:bigint>>")
    def best(lists: pa.Array) -> pa.Array:
        # Counter keeps the order of first places, and so do ties.
        found = [Counter(w for w in own or () if w not in stop).most_common(k) for own in lists.to_pylist()]
        return pa.array(found, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))

    return best(T._all(F.lower(F.col(column)), "[a-z]{4,}"))


def top_keywords(df: DataFrame, keys: list[str], column: str, k: int = 10) -> DataFrame:
    """`keywords` of each row, by rank; keys are those of single rows, so nothing is shuffled."""
    placed = df.select(*keys, F.posexplode(keywords(column, k)).alias("at", "x"))
    return placed.select(*keys, (F.col("at") + 1).cast("long").alias("rank"), "x.word", "x.n")


def section_of(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """The innermost section of each chunk's start: an interval join within the document; sections do not nest in their spans, so the
    latest start decides."""
    s = found.select("doc_id", F.col("start").alias("s_start"), F.col("stop").alias("s_stop"), "title", "level")
    within = (F.col("start") >= F.col("s_start")) & (F.col("start") < F.col("s_stop"))
    pairs = chunks.join(s, "doc_id").where(within)
    return pairs.groupBy("doc_id", "chunk_index").agg(F.max_by("title", "s_start").alias("title"), F.max_by("level", "s_start").alias("level"))



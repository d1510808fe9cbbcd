"""Finding parts of words, likeness and patterns for a whole table of search terms, by an index over the distinct words of the texts.

The words (runs without white space, in lower case) of all texts are made distinct once; everything that concerns letters is decided on
them. Parts of words come from a k-gram index over the words: the two rarest grams of a part are intersected and what is left is
verified. Words that are alike meet through the rarest letters of their letter sets. Phrases and wildcards are then decided on positional
postings (text, line, place) of the words that were met: the postings of each literal are shifted by its offset in the pattern and
intersected; parts divided by a star must follow each other in a line. No text is joined or shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.scratch import materialize

GRAM = 3
#: Rows of a table that is broadcast, counted first.
SMALL = 200_000
#: What Spark's \s matches: white space between words. A line ends at \n.
_GAP, _WORD = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]+"


def small(df: DataFrame) -> DataFrame:
    """df, a materialized table, with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def vocabulary(texts: DataFrame, text: str) -> DataFrame:
    """word: the distinct words of all texts, written once."""
    return materialize(texts.select(F.explode(F.array_distinct(F.split(text, rf"{_GAP}+"))).alias("word")).where("word <> ''").distinct(), "vocabulary")


def _grams(column: str, size: Column | int) -> Column:
    """Distinct runs of `size` letters."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.when(F.length(column) >= size, F.sequence(F.lit(1), F.length(column) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(F.col(column), i, size)))


def holding(words: DataFrame, parts: DataFrame) -> DataFrame:
    """part, word: every word that contains a part. parts: distinct, not empty. Parts shorter than a gram are looked up by grams of their length."""
    size = F.least(F.length("part"), F.lit(GRAM))
    wanted = materialize(parts.select("part", size.alias("k"), F.explode(_grams("part", size)).alias("gram")), "grams")
    sizes = sorted(r[0] for r in wanted.select("k").distinct().collect())  # 1 to GRAM
    if not sizes:
        return parts.select("part", F.col("part").alias("word")).limit(0)
    lists = words.select("word", F.explode(F.flatten(F.array(*[_grams("word", k) for k in sizes]))).alias("gram"))
    index = materialize(lists.join(small(wanted.select("gram").distinct()), "gram", "left_semi"), "gram-index")
    counts = index.groupBy("gram").agg(F.count("*").alias("df"))
    rare = wanted.join(counts, "gram", "left").groupBy("part").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))), 1, 2).alias("r"))
    rare = materialize(rare.select("part", F.col("r")[0]["gram"].alias("gram"), F.element_at("r", -1)["gram"].alias("second")), "rare")
    first = index.join(small(rare), "gram")
    # The second list, shifted onto the first by word; a part with one gram has its list alone.
    both = first.join(index.select("word", F.col("gram").alias("second")), ["word", "second"], "left_semi")
    return both.where(F.contains("word", "part")).select("part", "word")


def letters(c: Column | str) -> Column:
    return F.array_distinct(F.split(c, ""))


def alike(words: DataFrame, terms: DataFrame, least: float) -> DataFrame:
    """term, word, alike: words whose letters have a Jaccard similarity over `least` with the term's. Sets that similar share one of their
    first letters in any fixed order; the order is from the highest code point down, where letters tend to be rare."""

    def keyed(df: DataFrame, column: str, own: str) -> DataFrame:
        ordered = F.sort_array(letters(column), asc=False)
        n = F.size(ordered)
        prefix = F.slice(ordered, 1, F.greatest(n - F.ceil(n * least).cast("int") + 1, F.lit(1)))
        return df.select(F.col(column), ordered.alias(own), F.explode(prefix).alias("letter"))

    # Words of one letter set stand together: there are far fewer sets than words.
    sets = materialize(words.select("word", F.array_join(F.sort_array(letters("word")), "").alias("set")), "letter-sets")
    asked = terms.select("term", F.array_join(F.sort_array(letters("term")), "").alias("wanted"))
    own, other = keyed(sets.select("set").distinct(), "set", "a"), keyed(asked.select("wanted").distinct(), "wanted", "b")
    near = F.size("a").between(F.size("b") * least, F.size("b") / least)
    met = own.join(small(materialize(other, "wanted-sets")), "letter").where(near).select("set", "wanted", T.jaccard(F.col("a"), F.col("b")).alias("alike")).where(F.col("alike") > least).distinct()
    met = materialize(met, "alike")
    return sets.join(small(met), "set").join(small(materialize(asked, "asked-sets")), "wanted").select("term", "word", "alike")


def postings(texts: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """key, line, at, gap, size, word: every place of the given words (distinct, materialized), by line and character; gap is the white
    space before the word in its line, size the line's length. Few words are broadcast to the scan, many are joined by word after it."""
    few = words.count() <= SMALL
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in words.collect())) if few else None

    def places(batches: Iterator[pa.RecordBatch]):
        find, wanted = re.compile(_WORD).finditer, shared.value if shared else None
        for batch in batches:
            keys, rows, held = batch.column(0), [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for number, line in enumerate((t or "").split("\n")):
                    end = 0
                    for m in find(line):
                        word = m.group()
                        if wanted is None or word in wanted:
                            rows.append((number, m.start(), line[end : m.start()], len(line), word))
                            held.append(r)
                        end = m.end()
                if len(rows) > 1 << 15:
                    yield _rows(keys, held, rows)
                    rows, held = [], []
            if rows:
                yield _rows(keys, held, rows)

    kind = texts.schema[key].dataType.simpleString()
    found = texts.select(F.col(key).alias("key"), text).mapInArrow(places, f"key {kind}, line int, at int, gap string, size int, word string")
    return (found if few else found.join(words, "word")).select(F.col("key").alias(key), "line", "at", "gap", "size", "word")


def _rows(keys: pa.Array, held: list[int], rows: list[tuple]) -> pa.RecordBatch:
    line, at, gap, size, word = zip(*rows)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(held)), pa.array(line, pa.int32()), pa.array(at, pa.int32()), pa.array(gap), pa.array(size, pa.int32()), pa.array(word)], ["key", "line", "at", "gap", "size", "word"])


# ---- patterns ----------------------------------------------------------------------------------------------------------


def literals(term: str, wild: bool) -> list[tuple]:
    """(segment, literal number, literal, offset, gap, length): what a term consists of. A star ends a segment; a question mark is any one
    character; white space parts literals. gap is the white space that must stand before a literal, None where any text may; length is the
    segment's. A run of marks with a star in it counts its question marks to the segment before it, or after it at the start."""
    if not wild:
        found = list(re.finditer(_WORD, term))
        return [(0, n, m.group(), m.start(), term[found[n - 1].end() : m.start()] if n else None, len(term)) for n, m in enumerate(found)]
    parts = re.split(r"([*?]*\*[*?]*)", term)
    texts, marks = parts[::2], parts[1::2]
    for k, mark in enumerate(marks):
        more = "?" * mark.count("?")
        if texts[k].strip("?"):
            texts[k] += more
        else:
            texts[k + 1], texts[k] = texts[k] + more + texts[k + 1], ""
    out, segment = [], 0
    for part in texts:
        found = list(re.finditer(r"[^?]+", part))
        out += [(segment, n, m.group(), m.start(), None, len(part)) for n, m in enumerate(found)]
        segment += bool(found)
    if out and not texts[-1].strip("?") and texts[-1]:  # nothing but question marks behind the last star
        last = out[-1][0]
        out = [(*x[:5], x[5] + len(texts[-1])) if x[0] == last else x for x in out]
    return out


def parsed(terms: DataFrame) -> DataFrame:
    """item_id, pos, segment, n, literal, offset, gap, length of terms(item_id, pos, term, wild)."""
    rule = F.udf(lambda term, wild: literals(term, wild), "array<struct<segment:int,n:int,literal:string,offset:int,gap:string,length:int>>")
    return terms.select("item_id", "pos", F.inline(rule("term", "wild")))


def matches(texts: DataFrame, key: str, text: str, terms: DataFrame, words: DataFrame) -> DataFrame:
    """item_id, pos, key: the texts (in lower case) in which a term (lower case) is found anywhere. terms: item_id, pos, term, wild; words: the
    vocabulary of the texts. In wild terms * is any characters of a line and ? is one."""
    parts = materialize(parsed(terms), "literals")
    if parts.isEmpty():
        return terms.select("item_id", "pos").join(texts.select(key).limit(0), F.lit(True)).limit(0)
    met = holding(words, parts.select(F.col("literal").alias("part")).distinct())
    offsets = F.filter(F.sequence(F.lit(0), F.length("word") - F.length("part")), lambda i: F.substring("word", i + 1, F.length("part")) == F.col("part"))
    met = materialize(met.select("word", F.col("part").alias("literal"), offsets.alias("offsets")), "met")
    places = materialize(postings(texts, key, text, materialize(met.select("word").distinct(), "words")), "places")
    pattern = ["item_id", "pos", "segment"]
    asked = met.join(small(parts), "literal").select(*pattern, "n", "offset", "word", "offsets", F.col("gap").alias("needs"), "length")
    found = places.join(small(materialize(asked, "asked")), "word")
    found = found.select(*pattern, "n", key, "line", "size", "length", F.explode("offsets").alias("within"), "at", "offset", "gap", "needs")
    # A literal behind white space begins its word.
    found = found.where(F.col("needs").isNull() | ((F.col("needs") == F.col("gap")) & (F.col("within") == 0)))
    # Every literal's places, shifted back to where its segment begins.
    shifted = found.select(*pattern, "n", key, "line", "length", (F.col("at") + F.col("within") - F.col("offset")).alias("start"), "size")
    shifted = shifted.where((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("size"))).drop("size")
    shape = parts.groupBy(*pattern).agg(F.count("*").alias("literals"))
    shape = materialize(shape.join(parts.groupBy("item_id", "pos").agg((F.max("segment") + 1).alias("segments")), ["item_id", "pos"]), "shape")
    shifted = shifted.join(small(shape), pattern)
    simple = (F.col("segments") == 1) & (F.col("literals") == 1)
    done = shifted.where(simple).select("item_id", "pos", key).distinct()
    if not shape.where(~simple).isEmpty():
        line = ["item_id", "pos", key, "line"]
        met_all = shifted.where(~simple).groupBy(*line, "segment", "segments", "start", "length").agg(F.count_distinct("n").alias("have"), F.first("literals").alias("literals"))
        whole = materialize(met_all.where("have = literals").select(*line, "segment", "segments", "start", (F.col("start") + F.col("length")).alias("end")), "segments")
        # The earliest end of each segment that begins behind the one before it.
        most = shape.agg(F.max("segments")).first()[0]
        ends = whole.where("segment = 0").groupBy(*line, "segments").agg(F.min("end").alias("reached"))
        for k in range(1, most):
            done = done.union(ends.where(F.col("segments") == k).select("item_id", "pos", key))
            following = whole.where(F.col("segment") == k).join(ends.where(F.col("segments") > k).select(*line, "reached"), line)
            ends = following.where("start >= reached").groupBy(*line, "segments").agg(F.min("end").alias("reached"))
        done = done.union(ends.where(F.col("segments") == most).select("item_id", "pos", key))
    return done.distinct()

"""Benchmark decontamination by a distributed positional inverted index.

The index holds one posting (document key, term, position) for every document word that is a benchmark term, sharded as the documents
are, so building it shuffles nothing. Every window of a benchmark item is looked up from its rarest term: that term's list, shifted
by its offset in the item, gives alignments of item and document; the shifted list of the window's second rarest term is intersected
with them; what is left is intersected with the lists of all other terms round the anchor, and runs of adjacent hits that are a whole
window long are exact phrase matches. With slop > 0 the first intersection also keeps alignments whose two rarest terms stand within
slop words of their places: proximity matches. The query counts both kinds.

DataFrame operations only. Joins after the index are by document and position, so no term, however common, is a join key of its own
in a shuffle, and identical alignments met through several anchors are merged before they are extended.

Cases: null or wordless texts have no words and no hits. Items without words match nothing. Items shorter than a window are one
window. Repeated documents (equal id and text) each keep their row; equal ids with other texts are told apart by the key. Equal items
both match. An item without an id marks words as hit, but has no id to be listed. Words are runs of characters outside ASCII other than digits and letters, after A-Z are lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import KEY, materialize, row_key, small

WINDOW = 13
#: Words by which the two rarest terms of a window may be off their places in a proximity match.
SLOP = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands after the last word of every document in the index; no word looks like it.
END = "#"


def words(text: str) -> Column:
    """Words of a text; lower() is the same as lower-casing A-Z where every character is one byte, and much faster."""
    plain = F.octet_length(text) == F.char_length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.regexp_extract_all(F.coalesce(low, F.lit("")), F.lit(_WORD), F.lit(0))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item_id, item, n, j, word) of every distinct item; item_id is a string, empty where it is null."""
    split = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words("text").alias("w")).distinct()
    split = split.withColumn("item", F.xxhash64("item_id", "w"))
    return split.select("item_id", "item", F.size("w").alias("n"), F.posexplode("w").alias("j", "word"))


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Postings (KEY, doc_id, term, pos). terms: (word, term), where END has term 0; its posting carries the document's word count."""
    base = docs.select(F.col(doc_id).alias("doc_id"), *row_key(text, doc_id), words(text).alias("w"))
    placed = base.select("doc_id", *KEY, F.posexplode(F.concat("w", F.array(F.lit(END)))).alias("pos", "word"))
    return placed.join(small(terms), "word").select("doc_id", *KEY, "term", "pos")


def match_items(index: DataFrame, items: DataFrame, terms: DataFrame, window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Phrase matches (KEY, item_id, start, length) and proximity matches (KEY, item_id, start), both by document position."""
    counts = index.groupBy("term").agg(F.count("*").alias("cf"))
    placed = items.join(small(terms), "word").join(counts, "term")  # an item word that no document has ends its windows
    placed = materialize(placed.select("item_id", "item", "n", "j", "term", "cf"), "placed")
    by_item = W.partitionBy("item_id", "item").orderBy("j")
    span = by_item.rowsBetween(0, window - 1)
    ahead = placed.select(
        "item_id", "item", "n", "j", "term",
        F.count("*").over(span).alias("had"), F.max("j").over(span).alias("last"),
        F.slice(F.array_sort(F.collect_list(F.struct("cf", "j", "term")).over(span)), 1, 2).alias("rare"),
    )
    size = F.least(F.col("n"), F.lit(window))
    lookups = (
        ahead.where((F.col("had") == size) & (F.col("last") - F.col("j") == size - 1))
        .select("item_id", "item", F.col("rare")[0].alias("a"), F.element_at("rare", -1).alias("b"))
        .select("item_id", "item", F.col("a.j").alias("j1"), F.col("a.term").alias("t1"), F.col("b.j").alias("j2"), F.col("b.term").alias("t2"))
        .distinct()
    )
    lookups = materialize(lookups, "lookups")
    first = lookups.select("item_id", "item", "j1", F.col("t1").alias("term")).distinct()
    aligned = index.join(small(first), "term").select(*KEY, "item_id", "item", "j1", (F.col("pos") - F.col("j1")).alias("start"))
    wanted = aligned.join(small(lookups.select("item_id", "item", "j1", "j2", "t2")), ["item_id", "item", "j1"])
    second = index.join(small(lookups.select(F.col("t2").alias("term")).distinct()), "term", "left_semi")
    both = wanted.select("*", (F.col("start") + F.col("j2")).alias("pos"), F.col("t2").alias("term")).join(second.select(*KEY, "pos", "term"), [*KEY, "pos", "term"])
    kept = materialize(both.select(*KEY, "item_id", "item", "j1", "start").distinct(), "alignments")

    # All terms within a window of the anchor, by their own shifted lists; only documents with an alignment are read.
    reached = placed.select("item_id", "item", "n", "j", "term")
    near = kept.join(small(reached), ["item_id", "item"]).where(F.abs(F.col("j") - F.col("j1")) < window)
    near = near.select(*KEY, "item_id", "item", "n", "start", "j", "term", (F.col("start") + F.col("j")).alias("pos")).distinct()
    some = index.join(small(kept.select(*KEY).distinct()), KEY, "left_semi").select(*KEY, "term", "pos").distinct()
    hit = near.join(some, [*KEY, "term", "pos"])
    line = ["item_id", "item", "start"]
    run = hit.withColumn("run", F.col("j") - F.row_number().over(W.partitionBy(*KEY, *line).orderBy("j")))
    runs = run.groupBy(*KEY, *line, "run").agg(F.min("pos").alias("from"), F.count("*").alias("length"), F.max("n").alias("n"))
    phrases = runs.where(F.col("length") >= F.least(F.col("n"), F.lit(window))).select(*KEY, "item_id", F.col("from").alias("start"), "length")
    if not slop:
        return phrases, phrases.select(*KEY, "item_id", "start").limit(0)
    # Both rarest terms, each at most slop words off its place: equal cells of slop + 1 words, or neighbouring ones.
    cell = lambda c: F.floor(c / (slop + 1)).cast("long")
    spread = wanted.withColumn("at", F.col("start") + F.col("j2")).withColumn("cell", F.explode(F.array(*[cell(F.col("at")) + d for d in (-1, 0, 1)])))
    close = spread.join(second.select(*KEY, F.col("term").alias("t2"), "pos").withColumn("cell", cell(F.col("pos"))), [*KEY, "t2", "cell"])
    return phrases, close.where(F.abs(F.col("pos") - F.col("at")) <= slop).select(*KEY, "item_id", "start").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", slop: int = 0) -> DataFrame:
    """KEY, doc_id, n_words, n_hit, items (sorted array of item ids as strings), contaminated; n_near (items by proximity) if slop."""
    items = materialize(item_words(benchmark), "items")
    distinct = items.select("word").distinct().union(docs.sparkSession.range(1).select(F.lit(END).alias("word")))
    terms = materialize(distinct.select("word", F.when(F.col("word") == END, 0).otherwise(F.xxhash64("word")).alias("term")), "terms")
    index = materialize(build_index(docs, terms, text, doc_id), "postings")
    phrases, close = match_items(index, items, terms, window, slop)
    found = materialize(phrases, "phrases")
    places = found.select(*KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length").cast("int") - 1)).alias("pos")).distinct()
    n_hit = places.groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    # Ids as strings in the order of their bytes.
    by_doc = found.where("item_id != ''").select(*KEY, F.col("item_id").alias("i")).distinct().groupBy(*KEY).agg(F.array_sort(F.collect_list("i")).alias("items"))
    ends = index.where(F.col("term") == 0).select("doc_id", *KEY, F.col("pos").cast("long").alias("n_words"))
    out = ends.join(n_hit.join(by_doc, KEY, "left"), KEY, "left")
    if slop:
        out = out.join(close.select(*KEY, "item_id").distinct().groupBy(*KEY).agg(F.count("*").alias("n_near")), KEY, "left").fillna(0, ["n_near"])
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = decontaminate(docs, benchmark, slop=SLOP)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near",
    )


_SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS n, unnest(list_transform(range(1, greatest(len(w) - {WINDOW}, 0) + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, sizes WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY 1),
ij AS (SELECT item_id, len(w) AS n, unnest(range(len(w))) AS j, unnest(w) AS word FROM b),
dt AS MATERIALIZED (SELECT * FROM (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM d) SEMI JOIN ij USING (word)),
pl AS (SELECT item_id, j, word, cf FROM ij JOIN (SELECT word, count(*) AS cf FROM dt GROUP BY 1) USING (word)),
ws AS (SELECT item_id, least(n, {WINDOW}) AS size, unnest(range(greatest(n - {WINDOW}, 0) + 1)) AS s FROM (SELECT DISTINCT item_id, n FROM ij)),
wr AS (SELECT ws.item_id, s, size, j, word, row_number() OVER (PARTITION BY ws.item_id, s ORDER BY cf, j) AS r, count(*) OVER (PARTITION BY ws.item_id, s) AS had FROM ws JOIN pl ON pl.item_id = ws.item_id AND j >= s AND j < s + size),
lk AS (SELECT DISTINCT x.item_id, x.j AS j1, x.word AS t1, y.j AS j2, y.word AS t2 FROM wr x JOIN wr y ON x.item_id = y.item_id AND x.s = y.s AND x.r = 1 AND y.r = least(2, y.had) WHERE x.had = x.size),
al AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, t2, p - j1 + j2 AS place FROM lk JOIN dt ON word = t1),
nr AS (SELECT al.doc_id, count(DISTINCT item_id) AS n_near FROM al JOIN dt ON dt.doc_id = al.doc_id AND word = t2 WHERE abs(p - place) <= {SLOP} GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
 coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN nr USING (doc_id)"""

"""Queries over document structure and chunk tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import chunking as C
from quern.sources import derived as D

from .text_queries import _any, _strings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


CH = D.chunks_sql()
_CODE = _any("text", ["def ", "function ", "class ", "import ", "from ", "public class", "private ", "void "])


def analyzed(df):
    """One row of structure for each document."""
    t = F.col("text")
    paragraphs = F.split(t, "\n")
    code = sum((F.contains(t, F.lit(x)).cast("int") for x in ["def ", "function ", "class ", "import ", "from ", "public class", "private ", "void "]), F.lit(0))
    return df.select(
        "doc_id", T.word_count("text").alias("n_words"), F.size(paragraphs).cast("long").alias("n_lines"), F.round(T.word_count("text") / F.size(paragraphs), 4).alias("mean_line_words"),
        t.rlike(r"(?m)^\s*(?:[-*+]|[0-9]+\.)\s+\S").alias("has_list"), F.contains(t, F.lit(" | ")).alias("has_table"), F.contains(t, F.lit("```")).alias("has_code"), t.rlike(T.LINK).alias("has_link"), code.cast("long").alias("code_marks"), F.length(t).cast("long").alias("n_chars"),
        F.size(F.array_distinct(T.words("text"))).cast("long").alias("n_unique"), F.regexp_count(t, F.lit(r"[^\p{L}\p{N}_\s]")).cast("long").alias("n_special"),
    )


_ANALYZED = rf"""an AS (SELECT doc_id, len(regexp_extract_all(lower(text), '{T.WORD}')) AS n_words, len(string_split(text, chr(10))) AS n_lines, round(len(regexp_extract_all(lower(text), '{T.WORD}')) / len(string_split(text, chr(10))), 4) AS mean_line_words,
 regexp_matches(text, '(?m)^\s*(?:[-*+]|[0-9]+\.)\s+\S') AS has_list, contains(text, ' | ') AS has_table, contains(text, '```') AS has_code, regexp_matches(text, '{T.LINK}') AS has_link,
 ({' + '.join(f"contains(text, '{x}')::INT" for x in ["def ", "function ", "class ", "import ", "from ", "public class", "private ", "void "])})::BIGINT AS code_marks, length(text) AS n_chars,
 len(list_distinct(regexp_extract_all(lower(text), '{T.WORD}'))) AS n_unique, len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}_\s]')) AS n_special FROM documents)"""


@query("d1_analyze_document", f"WITH {_ANALYZED} SELECT * FROM an")
def _(spark, d):
    return analyzed(D.table(spark, d, "documents"))


_SECTIONS = rf"""{D.MARKDOWN_SQL}, ln AS (SELECT doc_id, length(md) AS n, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, md, string_split(md, chr(10)) AS l FROM md)),
 pl AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ln),
 hd AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS sec, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+[ \t]+(.*)$', 1)) AS title, start FROM pl WHERE regexp_matches(line, '^#{{1,6}}[ \t]+\S')),
 sc AS (SELECT doc_id, sec, level, title, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY sec), n) AS stop FROM hd)"""


@query("d2_section_table", f"WITH {_SECTIONS} SELECT s.doc_id, s.sec, s.level, s.title, s.start, s.stop, max(p.sec) AS parent FROM sc s LEFT JOIN sc p ON p.doc_id = s.doc_id AND p.sec < s.sec AND p.level < s.level GROUP BY ALL")
def _(spark, d):
    return C.sections(D.markdown(spark, d), "md")


@query(
    "d3_section_flags",
    rf"WITH {_SECTIONS}, b AS (SELECT doc_id, sec, md[start + 1:stop] AS b FROM sc JOIN md USING (doc_id)) SELECT doc_id, sec, contains(b, '```') AS has_code, regexp_matches(b, '(?m)^\|.*\|$') AS has_table, regexp_matches(b, '(?m)^\s*(?:[-*+]|[0-9]+\.)\s+\S') AS has_list, CASE WHEN regexp_matches(b, '(?m)^\|.*\|$') THEN 'table' WHEN contains(b, '```') THEN 'code' WHEN regexp_matches(b, '(?m)^\s*(?:[-*+]|[0-9]+\.)\s+\S') THEN 'list' ELSE 'text' END AS kind, len(regexp_extract_all(lower(b), '{T.WORD}')) AS n_words, len(string_split(b, chr(10))) AS n_lines FROM b",
)
def _(spark, d):
    return C.section_flags(D.markdown(spark, d), "md")


def complexity():
    return F.least(F.lit(1.0), 0.15 * F.col("has_code").cast("int") + 0.1 * F.col("has_table").cast("int") + 0.05 * F.col("has_list").cast("int") + F.least(F.col("code_marks") / 10, F.lit(0.2)) + F.least(F.col("n_lines") / 20, F.lit(0.2)))


def density():
    n = F.greatest(F.col("n_chars"), F.lit(1))
    return F.least(F.lit(1.0), 2 * (0.5 * F.col("n_words") / n + 0.3 * F.col("n_unique") / F.greatest(F.col("n_words"), F.lit(1)) + 0.2 * F.col("n_special") / n))


_COMPLEXITY = "least(1.0::DOUBLE, 0.15::DOUBLE * has_code::INT + 0.1::DOUBLE * has_table::INT + 0.05::DOUBLE * has_list::INT + least(code_marks / 10, 0.2::DOUBLE) + least(n_lines / 20, 0.2::DOUBLE))"
_DENSITY = "least(1.0::DOUBLE, 2 * (0.5::DOUBLE * n_words / greatest(n_chars, 1) + 0.3::DOUBLE * n_unique / greatest(n_words, 1) + 0.2::DOUBLE * n_special / greatest(n_chars, 1)))"


@query("d4_structure_scores", f"WITH {_ANALYZED} SELECT doc_id, round({_COMPLEXITY}, 4) AS complexity, round({_DENSITY}, 4) AS density FROM an")
def _(spark, d):
    return analyzed(D.table(spark, d, "documents")).select("doc_id", F.round(complexity(), 4).alias("complexity"), F.round(density(), 4).alias("density"))


@query(
    "d5_recommend_chunking",
    f"""WITH {_ANALYZED}, k AS (SELECT *, {_COMPLEXITY} AS cx FROM an), s AS (SELECT *, CASE WHEN mean_line_words > 500 THEN floor(1500 * 1.2) WHEN mean_line_words < 100 THEN floor(1500 * 0.8) ELSE 1500 END AS s1 FROM k)
SELECT doc_id, CASE WHEN code_marks >= 2 THEN 'structural' WHEN has_table AND has_list THEN 'structural' WHEN mean_line_words > 300 THEN 'semantic' ELSE 'hybrid' END AS strategy, least(2500, greatest(800, CASE WHEN cx > 0.7 THEN floor(s1 * 0.9) WHEN cx < 0.3 THEN floor(s1 * 1.1) ELSE s1 END))::BIGINT AS size FROM s""",
)
def _(spark, d):
    a = analyzed(D.table(spark, d, "documents"))
    strategy = F.when(F.col("code_marks") >= 2, "structural").when(F.col("has_table") & F.col("has_list"), "structural").when(F.col("mean_line_words") > 300, "semantic").otherwise("hybrid")
    s1 = F.when(F.col("mean_line_words") > 500, F.floor(F.lit(1500 * 1.2))).when(F.col("mean_line_words") < 100, F.floor(F.lit(1500 * 0.8))).otherwise(1500)
    size = F.when(complexity() > 0.7, F.floor(s1 * 0.9)).when(complexity() < 0.3, F.floor(s1 * 1.1)).otherwise(s1)
    return a.select("doc_id", strategy.alias("strategy"), F.least(F.lit(2500), F.greatest(F.lit(800), size)).cast("long").alias("size"))


_ELEMENTS = rf"""{D.MARKDOWN_SQL}, ln AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS l FROM md)),
 pl AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS marks FROM ln),
 kd AS (SELECT *, CASE WHEN marks % 2 = 1 OR starts_with(line, '```') THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}\s+\S') THEN 'header' WHEN regexp_matches(line, '^\s*(?:[-*+]|[0-9]+\.)\s+\S') THEN 'list' WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table' WHEN starts_with(line, '>') THEN 'quote' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind FROM pl),
 ch AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY i) <> kind OR (starts_with(line, '```') AND marks % 2 = 1) OR kind = 'header', true) AS c FROM kd),
 rn AS (SELECT *, sum(c::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM ch),
 el AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) AS element, kind, min(start) AS start, max(start + length(line)) AS stop, count(*) AS n_lines FROM rn WHERE kind <> 'blank' GROUP BY doc_id, run, kind)"""


@query("d6_structural_elements", f"WITH {_ELEMENTS} SELECT doc_id, element, kind, start, stop, n_lines FROM el")
def _(spark, d):
    return C.elements(D.markdown(spark, d), "md")


def _pack_sql(pieces: str, source: str, limit: int, extra: int, joiner: str, carry: int = 0) -> str:
    """Greedy packing as a recursive CTE over numbered pieces."""
    return f"""WITH RECURSIVE pc AS (SELECT doc_id, {pieces} AS p FROM {source}),
st AS (SELECT doc_id, p, 1 AS i, 1 AS f, 0 AS s, 0 AS g, NULL::STRUCT(f INT, l INT) AS o FROM pc WHERE len(p) > 0
 UNION ALL SELECT doc_id, p, i + 1, CASE WHEN k THEN i - b ELSE f END, CASE WHEN k THEN held + z ELSE s + z END, CASE WHEN k THEN g + 1 ELSE g END, CASE WHEN k THEN {{'f': f, 'l': i - 1}} END
 FROM (SELECT *, length(p[i]) + {extra} AS z, s > 0 AND s + length(p[i]) + {extra} > {limit} AS k, least({carry}, i - f)::INT AS b, coalesce(list_sum(list_transform(p[i - least({carry}, i - f):i - 1], lambda x: length(x) + {extra})), 0)::INT AS held FROM st WHERE i <= len(p))),
gr AS (SELECT doc_id, g - 1 AS g, p, o.f AS f, o.l AS l FROM st WHERE o IS NOT NULL UNION ALL SELECT doc_id, g, p, f, len(p) FROM st WHERE i = len(p) + 1)
SELECT doc_id, g::BIGINT AS chunk_index, array_to_string(p[f:l], '{joiner}') AS content FROM gr"""


_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+\s+'), lambda s: trim(s)), lambda s: length(s) > 0)"


@query("d16_chunk_by_sentence", f"SELECT doc_id, chunk_index, md5(content) AS content_md5 FROM ({_pack_sql(_SENT, 'documents', 2000, 1, ' ', 2)})")
def _(spark, d):
    return C.by_sentence(D.table(spark, d, "documents"), "text").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("d17_chunk_by_paragraph", f"SELECT doc_id, chunk_index, md5(content) AS content_md5 FROM ({_pack_sql('list_filter(list_transform(string_split(md, chr(10) || chr(10)), lambda s: trim(s)), lambda s: length(s) > 0)', '(WITH ' + D.MARKDOWN_SQL + ' SELECT * FROM md)', 2000, 2, chr(10) + chr(10))})")
def _(spark, d):
    return C.by_paragraph(D.markdown(spark, d), "md").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("c29_split_long_paragraphs", f"SELECT doc_id, chunk_index, md5(content) AS content_md5 FROM ({_pack_sql(_SENT, 'documents', 1000, 1, ' ')})")
def _(spark, d):
    return C.by_sentence(D.table(spark, d, "documents"), "text", 1000, 0).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("c30_paginate_content", f"SELECT doc_id, chunk_index, md5(content) AS content_md5 FROM ({_pack_sql('list_filter(list_transform(string_split(md, chr(10) || chr(10)), lambda s: trim(s)), lambda s: length(s) > 0)', '(WITH ' + D.MARKDOWN_SQL + ' SELECT * FROM md)', 4000, 2, chr(10) + chr(10))})")
def _(spark, d):
    return C.by_paragraph(D.markdown(spark, d), "md", 80 * 50).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("d22_chunk_word_window")
def _(spark, d):
    """By words, all texts. A recursion over every word is too slow as SQL; tests/test_whole_job.py has a brute-force version."""
    return C.by_words(D.table(spark, d, "documents"), "text").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


def _first(shape: str, start: int) -> str:
    """The place, from 0, of the first match at `start` or behind it in p; null if there is none."""
    return f"CASE WHEN regexp_matches(p[{start + 1}:], '{shape}') THEN strpos(p[{start + 1}:], regexp_extract(p[{start + 1}:], '{shape}')) - 1 + {start} END"


_BREAK = ", ".join(f"{_first(shape, int(2000 * share) - 1)} + length(regexp_extract(p[{int(2000 * share)}:], '{shape}'))" if behind else _first(shape, int(2000 * share) + 1) for shape, share, behind in C.BREAKS)
_WHITE = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"


@query("d18_chunk_markdown", rf"""WITH RECURSIVE {D.MARKDOWN_SQL}, ln AS (SELECT doc_id, unnest(range(0, len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(md, chr(10)) AS l FROM md)), s AS (SELECT *, sum((i > 0 AND regexp_matches(line, '^#{{1,6}}[ \t\n\r\f]+[^ \t\n\r\f]'))::INT) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM ln),
 g AS (SELECT doc_id, s, string_agg(line, chr(10) ORDER BY i) AS t FROM s GROUP BY 1, 2), r AS (SELECT doc_id, s, 0 AS k, t, NULL::VARCHAR AS piece FROM g UNION ALL
 SELECT doc_id, s, k + 1, CASE WHEN p IS NOT NULL THEN ltrim(t[c + 1:], {_WHITE}) END, trim(CASE WHEN p IS NULL THEN t ELSE t[:c] END, {_WHITE}) FROM (SELECT *, coalesce({_BREAK}, 1600) AS c FROM (SELECT doc_id, s, k, t, CASE WHEN length(t) > 2000 THEN CASE WHEN contains(t[2002:], chr(10)) THEN t[:2000 + strpos(t[2002:], chr(10))] ELSE t END END AS p FROM r WHERE t IS NOT NULL)))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) - 1 AS chunk_index, md5(piece) AS content_md5 FROM r WHERE piece <> ''""")
def _(spark, d):
    return C.by_heading(D.markdown(spark, d), "md").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("d15_chunk_fixed", f"WITH {CH} SELECT doc_id, chunk_index, start, stop, md5(content) AS content_md5 FROM chunks")
def _(spark, d):
    return D.chunks(spark, d).select("doc_id", "chunk_index", "start", "stop", F.md5("content").alias("content_md5"))


for _name, _f, _from in (("d8_chunk_structural", C.structural, "md"), ("d11_chunk_semantic", C.semantic, "md"), ("d12_chunk_hybrid", C.hybrid, "md"), ("d14_chunk_recursive", C.recursive, "text"), ("d19_chunk_code", C.by_definition, "text"), ("d20_chunk_paragraph_then_sentence", C.by_paragraph_then_sentence, "md"), ("d21_chunk_sentence_overlap", C.by_sentence_size, "text")):
    QUERIES[_name] = lambda spark, d, f=_f, c=_from: f(D.markdown(spark, d) if c == "md" else D.table(spark, d, "documents"), c)


_SEP, _GAP = r"[.!?]+[ \t\n\r\f]+", r"\n[ \t\n\r\f]*\n"
_LENGTHS = "coalesce(list_sum(list_transform({}, lambda z: length(z))), 0)"


def _ends(split: str, marks: str, upto: str) -> str:
    """Where the marks end: a list, by what stands before each and their own lengths."""
    return f"list_transform(range(1, len({marks}) + 1), lambda k: {_LENGTHS.format(f'{split}[1:k]')} + {_LENGTHS.format(f'{marks}[1:k{upto}]')})"


_TURN = " ".join(f"WHEN {' OR '.join(f'starts_with(l, {chr(39)}{w}{m}{chr(39)})' for w in words for m in (' ', ','))} THEN {C.TRANSITION_STRENGTH[kind]}::DOUBLE" for kind, words in C.TRANSITIONS.items())
_TURN += f" WHEN {' OR '.join(f'starts_with(l, {chr(39)}{w}{chr(39)})' for w in C.CLOSINGS)} THEN {C.CLOSING_STRENGTH}::DOUBLE"
_BOUNDARIES = rf"""dd AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
 c AS (SELECT doc_id, text, unnest(range(0, length(text) - 200, 50)) AS pos FROM dd WHERE length(text) > 200),
 w AS (SELECT doc_id, pos, list_distinct(list_filter(regexp_extract_all(lower(text[pos + 1:pos + 200]), '[\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {_strings(C.TOPIC_STOP_WORDS)})) AS x, greatest(pos - 50, 0) AS f, text[greatest(pos - 50, 0) + 1:least(pos + 50, length(text))] AS r FROM c),
 pv AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY pos) AS y FROM w), si AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END AS s, regexp_split_to_array(r, '{_SEP}') AS sp, regexp_extract_all(r, '{_SEP}') AS mk FROM pv WHERE y IS NOT NULL),
 sh AS (SELECT doc_id, coalesce(list_min(list_transform({_ends('sp', 'mk', '')}, lambda e: [abs(f + e - pos), f + e]))[2], pos) AS position, 'topic_shift' AS kind, 1 - s AS strength FROM si WHERE s < 0.75),
 sp AS (SELECT doc_id, regexp_split_to_array(text, '{_SEP}') AS sp, regexp_extract_all(text, '{_SEP}') AS mk FROM dd), se AS (SELECT doc_id, unnest({_ends('sp', 'mk', ' - 1')}) AS position, unnest(list_transform(sp[2:], lambda z: lower(trim(z, ' ' || chr(9) || chr(10) || chr(12) || chr(13))))) AS l FROM sp),
 tu AS (SELECT doc_id, position, 'sentence' AS kind, CASE {_TURN} ELSE 0 END AS strength FROM se), pp AS (SELECT doc_id, regexp_split_to_array(text, '{_GAP}') AS sp, regexp_extract_all(text, '{_GAP}') AS mk FROM dd),
 bd AS (SELECT doc_id, unnest({_ends('sp', 'mk', '')}) AS position, 'paragraph' AS kind, 0.7::DOUBLE AS strength FROM pp UNION ALL SELECT * FROM tu WHERE strength > 0.3 UNION ALL SELECT * FROM sh WHERE position > 0)"""


@query("d9_semantic_boundaries", f"WITH {_BOUNDARIES} SELECT doc_id, position::BIGINT AS position, kind, round(strength, 6) AS strength FROM bd")
def _(spark, d):
    return C.boundaries(D.table(spark, d, "documents"), "text").select("doc_id", "position", "kind", F.round("strength", 6).alias("strength"))


@query("d9_topic_shifts", f"WITH {_BOUNDARIES} SELECT doc_id, position::BIGINT AS position, round(1 - strength, 6) AS similarity FROM bd WHERE kind = 'topic_shift'")
def _(spark, d):
    return C.boundaries(D.table(spark, d, "documents"), "text", ("topic_shift",)).select("doc_id", "position", F.round(1 - F.col("strength"), 6).alias("similarity"))


@query("d10_boundary_thinning")
def _(spark, d):
    return C.adjusted(C.boundaries(D.markdown(spark, d), "md", apart=50))


@query(
    "d23_merge_short_chunks",
    f"WITH {D.chunks_sql(300, 250)}, f AS (SELECT *, CASE WHEN length(content) >= 200 OR coalesce(lag(length(content)) OVER w >= 200, true) THEN 1 ELSE 0 END AS step FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)), r AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS run FROM f), g AS (SELECT doc_id, run, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS c, count(*) AS merged FROM r GROUP BY 1, 2) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS chunk_index, md5(c) AS content_md5, merged FROM g",
)
def _(spark, d):
    return C.merge_short(D.chunks(spark, d, 300, 250)).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"), "merged")


@query(
    "d24_apply_overlap",
    rf"WITH {CH}, b AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS p FROM chunks), n AS (SELECT *, least(greatest(floor(0.1 * least(length(p), length(content)))::INT, 100), 300, length(p)) AS n FROM b) SELECT doc_id, chunk_index, coalesce(length(regexp_replace(p[length(p) - n + 1:], '^\S*\s+', '')), 0) AS overlap_size FROM n",
)
def _(spark, d):
    return C.with_overlap(D.chunks(spark, d)).select("doc_id", "chunk_index", "overlap_size")


@query(
    "d25_adjacent_dedupe",
    f"WITH {CH}, b AS (SELECT *, lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS p FROM chunks), s AS (SELECT doc_id, chunk_index, coalesce(list_max(list_filter(range(1, least(200, length(content), length(p)) + 1), lambda n: p[length(p) - n + 1:] = content[1:n])), 0) AS shared FROM b WHERE p IS NOT NULL) SELECT doc_id, chunk_index, shared, CASE WHEN shared > 50 THEN shared ELSE 0 END AS dropped FROM s",
)
def _(spark, d):
    return C.adjacent_repeat(D.chunks(spark, d))


@query("d26_overlap_stats", f"WITH {CH}, b AS (SELECT doc_id, chunk_index, CASE WHEN chunk_index > 0 THEN greatest(lag(stop) OVER (PARTITION BY doc_id ORDER BY chunk_index) - start, 0) END AS o, stop - start AS n FROM chunks) SELECT count(*) AS n, round(avg((coalesce(o, 0) > 0)::INT), 6) AS covered, min(o) AS least, max(o) AS most, round(avg(o), 4) AS mean FROM b")
def _(spark, d):
    o = F.greatest(F.lag("stop").over(Win.partitionBy("doc_id").orderBy("chunk_index")) - F.col("start"), F.lit(0))
    b = D.chunks(spark, d).select(F.when(F.col("chunk_index") > 0, o).alias("o"))
    return b.agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce("o", F.lit(0)) > 0).cast("int")), 6).alias("covered"), F.min("o").alias("least"), F.max("o").alias("most"), F.round(F.avg("o"), 4).alias("mean"))


_SCORES = rf"""sc AS (SELECT *, round(CASE WHEN len(string_split(content, '. ')) < 2 THEN 1.0::DOUBLE WHEN NOT regexp_matches(regexp_replace(content, '\s+$', ''), '[.!?:;]$') THEN 0.6::DOUBLE ELSE least(1.0::DOUBLE, 0.85::DOUBLE + CASE WHEN regexp_matches(regexp_replace(content, '^\s+', ''), '^\p{{Lu}}') THEN 0.15::DOUBLE ELSE 0 END) END, 4) AS coherence,
 round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + CASE WHEN regexp_matches(content, '(?m)^\s*[-*+] ') AND (contains(content, '- ') OR contains(content, '* ')) AND NOT ends_with(content, '...') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN NOT contains(content, '```') THEN 0 WHEN len(regexp_extract_all(content, '```')) % 2 = 0 THEN 0.3::DOUBLE ELSE -0.2::DOUBLE END)), 4) AS completeness,
 list_filter(regexp_extract_all(lower(content), '{T.WORD}'), lambda x: length(x) > 2 AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM chunks),
 sd AS (SELECT *, round(CASE WHEN len(w) = 0 THEN 0 ELSE (least(1.0::DOUBLE, len(w) * 1000.0::DOUBLE / greatest(length(trim(content)), 1)) + len(list_distinct(w)) / len(w)) / 2 END, 4) AS density FROM sc),
 sq AS (SELECT *, round(0.4::DOUBLE * coherence + 0.3::DOUBLE * completeness + 0.3::DOUBLE * density, 6) AS quality FROM sd)"""


@query("d27_chunk_scores", f"WITH {CH}, {_SCORES} SELECT doc_id, chunk_index, coherence::DOUBLE AS coherence, completeness, density, quality FROM sq")
def _(spark, d):
    return C.scored(D.chunks(spark, d)).select("doc_id", "chunk_index", "coherence", "completeness", "density", "quality")


#: The chunk table beside the section table; both begin with the documents' Markdown.
_PLACED = f"""{_SECTIONS}, {D.chunks_sql()[len(D.MARKDOWN_SQL) + 2 :]}, cs AS (SELECT k.doc_id, k.chunk_index, max_by(title, s.start) AS section_title, max_by(level, s.start) AS section_level FROM chunks k JOIN sc s ON s.doc_id = k.doc_id AND k.start >= s.start AND k.start < s.stop GROUP BY 1, 2)"""


@query(
    "d28_enrich_chunks",
    f"WITH {_PLACED}, e AS (SELECT doc_id, chunk_index, concat_ws('_', doc_id, lpad(chunk_index::VARCHAR, 4, '0')) AS chunk_id, md5(content) AS hash, round(start / greatest(doc_length, 1), 6) AS position, section_title, coalesce(section_level, 0)::BIGINT AS section_level FROM chunks LEFT JOIN cs USING (doc_id, chunk_index)) SELECT *, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)",
)
def _(spark, d):
    c = C.with_section(C.enriched(D.chunks(spark, d)), C.sections(D.markdown(spark, d), "md"))
    return c.select("doc_id", "chunk_index", "chunk_id", "hash", "position", "section_title", "section_level", "previous_id", "next_id")


@query("d29_dedupe_chunks", f"WITH {D.chunks_sql(60, 60)} SELECT doc_id, min(chunk_index) AS chunk_index, md5(content) AS hash FROM chunks GROUP BY doc_id, md5(content)")
def _(spark, d):
    return C.deduped(D.chunks(spark, d, 60, 60)).select("doc_id", "chunk_index", F.md5("content").alias("hash"))


@query(
    "d30_cap_chunks",
    f"WITH {D.chunks_sql(200, 180)}, r AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY length(content) DESC, chunk_index) AS r FROM chunks) SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) - 1 AS new_index FROM r WHERE r <= 10",
)
def _(spark, d):
    return C.capped(D.chunks(spark, d, 200, 180).withColumn("n", F.length("content")), 10, "n").select("doc_id", "chunk_index", "new_index")


_IMPORTANCE = "round(least(0.4::DOUBLE * quality + CASE WHEN position < 0.1 THEN 0.2::DOUBLE WHEN position > 0.9 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(content) BETWEEN 500 AND 2000 THEN 0.1::DOUBLE WHEN length(content) < 200 OR length(content) > 3000 THEN -0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE), 8)"


@query("d31_importance_score", f"WITH {CH}, {_SCORES} SELECT doc_id, chunk_index, {_IMPORTANCE} AS importance FROM (SELECT *, start / greatest(doc_length, 1) AS position FROM sq)")
def _(spark, d):
    c = C.scored(D.chunks(spark, d))
    return c.select("doc_id", "chunk_index", C.importance(F.col("quality"), F.col("start") / F.greatest(F.col("doc_length"), F.lit(1)), F.length("content")).alias("importance"))


_KEYWORDS = f"kw AS (SELECT doc_id, chunk_index, w, count(*) AS n, min(pos) AS pos FROM (SELECT doc_id, chunk_index, unnest(k) AS w, unnest(range(0, len(k))) AS pos FROM (SELECT doc_id, chunk_index, regexp_extract_all(lower(content), '[a-z]{{4,}}') AS k FROM chunks)) WHERE w NOT IN {_strings(T.KEYWORD_STOP_WORDS)} GROUP BY 1, 2, 3), kr AS (SELECT doc_id, chunk_index, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY n DESC, pos) AS rank, w AS word, n FROM kw)"


@query("c12_top_keywords", f"WITH {CH}, {_KEYWORDS} SELECT doc_id, chunk_index, rank, word, n FROM kr WHERE rank <= 10")
def _(spark, d):
    return C.top_keywords(D.chunks(spark, d), ["doc_id", "chunk_index"], "content")


@query("d32_retrieval_metadata", f"WITH {CH}, {_KEYWORDS}, k AS (SELECT doc_id, chunk_index, string_agg(word, ',' ORDER BY rank) AS keywords FROM kr WHERE rank <= 10 GROUP BY 1, 2) SELECT c.doc_id, c.chunk_index, coalesce(keywords, '') AS keywords, length(content) AS size FROM chunks c LEFT JOIN k USING (doc_id, chunk_index)")
def _(spark, d):
    words = F.array_join(F.transform(C.keywords("content"), lambda x: x["word"]), ",")
    return D.chunks(spark, d).select("doc_id", "chunk_index", words.alias("keywords"), F.length("content").cast("long").alias("size"))


@query("d33_chunk_document")
def _(spark, d):
    """The whole of it, over all documents: those with even ids written as Markdown, the others as they are."""
    plain = D.table(spark, d, "documents").where("doc_id % 2 <> 0").select("doc_id", "text")
    every = D.markdown(spark, d).where("doc_id % 2 = 0").select("doc_id", F.col("md").alias("text")).union(plain)
    return C.document_chunks(every, "text").select("chunk_id", "doc_id", "chunk_index", "strategy", "start", "position", "overlap_size", "hash", "quality", "previous_id", "next_id")


@query("d35_content_report", r"SELECT doc_id, length(text) AS n_chars, ceil(length(text) / 2000)::BIGINT AS est_chunks, concat_ws(',', CASE WHEN length(text) > 10000 THEN 'split' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN length(text) < 200 THEN 'short' END) AS hints FROM documents")
def _(spark, d):
    n = F.length("text")
    hints = F.array_compact(F.array(F.when(n > 10000, "split"), F.when(F.contains("text", F.lit(" | ")), "table"), F.when(n < 200, "short")))
    return D.table(spark, d, "documents").select("doc_id", n.cast("long").alias("n_chars"), F.ceil(n / 2000).alias("est_chunks"), F.array_join(hints, ",").alias("hints"))


@query("e1_interval_join_section", f"WITH {_SECTIONS}, ct AS (SELECT doc_id, unnest(range(0, greatest(length(md) - 201, 0) + 1, 1800)) AS start, md FROM md), ck AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, start FROM ct WHERE trim(md[start + 1:start + 2000], ' ' || chr(10) || chr(9) || chr(13)) <> '') SELECT ck.doc_id, ck.chunk_index, max_by(title, s.start) AS title, max_by(level, s.start) AS level FROM ck JOIN sc s ON s.doc_id = ck.doc_id AND ck.start >= s.start AND ck.start < s.stop GROUP BY 1, 2")
def _(spark, d):
    return C.section_of(D.chunks(spark, d), C.sections(D.markdown(spark, d), "md"))


@query("g1_chunk_stats", f"WITH {CH} SELECT count(*) AS n, round(avg(length(content)), 4) AS mean, min(length(content)) AS least, max(length(content)) AS most, count(DISTINCT doc_id) AS docs FROM chunks")
def _(spark, d):
    n = F.length("content")
    return D.chunks(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("mean"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"), F.count_distinct("doc_id").alias("docs"))


@query("g3_chunks_per_file_topn", f"WITH {CH} SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 10")
def _(spark, d):
    return D.chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(10)


@query("g4_chunk_summary", f"WITH {CH}, {_SCORES} SELECT CASE WHEN quality >= 0.7 THEN 'high' WHEN quality >= 0.4 THEN 'medium' ELSE 'low' END AS quality, CASE WHEN length(content) < 500 THEN 'small' WHEN length(content) < 1500 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM sq GROUP BY ALL")
def _(spark, d):
    q, n = F.col("quality"), F.length("content")
    c = C.scored(D.chunks(spark, d)).select(F.when(q >= 0.7, "high").when(q >= 0.4, "medium").otherwise("low").alias("quality"), F.when(n < 500, "small").when(n < 1500, "medium").otherwise("large").alias("size"))
    return c.groupBy("quality", "size").agg(F.count("*").alias("n"))


@query("g19_chunk_quality_report", f"WITH {CH}, {_SCORES} SELECT round(avg((coherence >= 0.95)::INT), 6) AS coherent, round(avg((len(regexp_extract_all(content, '```')) % 2 = 0)::INT), 6) AS fences_even, count(*) FILTER (length(content) > 2000) AS oversized, round(avg((length(content) < 200)::INT), 6) AS undersized, avg(length(content)) BETWEEN 1050 AND 1950 AS mean_fits FROM sq")
def _(spark, d):
    n = F.length("content")
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return C.scored(D.chunks(spark, d)).agg(share(F.col("coherence") >= 0.95).alias("coherent"), share(F.regexp_count("content", F.lit("```")) % 2 == 0).alias("fences_even"), F.count_if(n > 2000).alias("oversized"), share(n < 200).alias("undersized"), F.avg(n).between(1050, 1950).alias("mean_fits"))

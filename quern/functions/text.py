"""Text functions as Column expressions: they stay in the JVM and fold into whatever plan uses them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: word lists and patterns that results depend on -----------------------------------------------------
INDEX_STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "can", "for", "from", "have", "if", "in", "is", "it", "may", "not", "of", "on", "or", "tbd", "that", "the", "this", "to", "us", "we", "when", "will", "with", "yet", "you", "your"]
KEYWORD_STOP_WORDS = ["the", "and", "are", "for", "not", "but", "have", "this", "that", "with", "from", "they", "she", "her", "his", "him", "you", "your", "can", "will", "was", "were", "been", "said", "each", "which"]
QUERY_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should"]
CODE_MARKS = ["def ", "class ", "import ", "function", "var ", "const ", "{", "}", ";", "//", "/*", "*/", "#!/", "SELECT ", "FROM "]
TOPICS = {
    "api": ["api", "endpoint", "request", "response"],
    "database": ["database", "query", "table", "sql"],
    "security": ["authentication", "login", "password", "security"],
    "configuration": ["configuration", "config", "settings"],
    "deployment": ["deployment", "docker", "kubernetes", "deploy"],
}
INTENTS = {
    "explain": ["what is", "explain", "describe", "definition of", "tell me about"],
    "compare": ["difference between", "compare", "vs", "versus", "which is better", "pros and cons", "advantages", "disadvantages"],
    "troubleshoot": ["error", "problem", "issue", "not working", "failed", "troubleshoot", "debug", "fix", "broken", "help with"],
    "procedure": ["how to", "how do i", "steps to", "guide", "tutorial", "create", "setup", "configure", "install"],
}
SHORTER = [("in order to", "to"), ("due to the fact that", "because"), ("in the event that", "if"), ("at this point in time", "now"), ("for the purpose of", "to"), ("with regard to", "regarding"), ("in accordance with", "per"), ("as a result of", "due to")]
WORD = r"[\p{L}\p{N}_]+"
URL = r"https?://[^\s<>\"']+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
VERSION = r"\b[0-9]+\.[0-9]+(?:\.[0-9]+)?\b"
FENCE = r"(?s)```(\w*)\n(.*?)```"
HEADING = r"(?m)^#{1,6}[ \t]+(.+)$"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
TAG_PATTERNS = [r"(?:^|\s)#([A-Za-z][A-Za-z0-9_]*)", r"@tag:([A-Za-z0-9_]+)"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _all(c, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(group))


def words(c) -> Column:
    """Lower-cased Unicode words."""
    return _all(F.lower(_c(c)), WORD)


def index_word_count(c) -> Column:
    """Words longer than one character that are not all digits."""
    return F.size(F.filter(words(c), lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))).cast("long")


def word_count(c) -> Column:
    return F.size(words(c)).cast("long")


def sentences(c) -> Column:
    return F.filter(F.transform(F.split(_c(c), r"[.!?]+\s+"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)


def lines(c) -> Column:
    return F.split(_c(c), "\n")


def contains_any(c, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(_c(c), F.lit(n)) for n in needles])


def clean(c) -> Column:
    """One space for white space, no rules of = - _, no zero-width characters."""
    out = F.regexp_replace(_c(c), r"\s+", " ")
    out = F.regexp_replace(out, r"[=\-_]{3,}", "")
    return F.trim(F.regexp_replace(out, "[​‌‍﻿]", ""))


def markdown_to_plain(c) -> Column:
    """Markdown without its marks; images go before links are reduced to their text."""
    steps = [
        (FENCE, "[CODE_BLOCK]"), (IMAGE, ""), (LINK, "$1"), (r"`([^`]+)`", "$1"), (r"\*{1,2}([^*]+)\*{1,2}", "$1"), (r"_{1,2}([^_]+)_{1,2}", "$1"),
        (r"(?m)^[-*+]\s+", ""), (r"(?m)^[0-9]+\.\s+", ""), (r"(?m)^>\s+", ""), (r"(?m)^#{1,6}\s+", ""),
    ]
    return clean(reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, _c(c)))


def title(c, path) -> Column:
    """First top heading, else the file's stem in title case."""
    stem = F.regexp_replace(F.regexp_extract(_c(path), r"([^/]*?)(?:\.[^./]*)?$", 1), "[-_]", " ")
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(_c(c), r"(?m)^#[ \t]+(.+)$", 1)), F.lit("")), F.initcap(stem))


def headings(c) -> Column:
    bare = lambda h: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"\*{1,2}([^*]+)\*{1,2}", "$1"), r"_{1,2}([^_]+)_{1,2}", "$1"), r"`([^`]+)`", "$1"))
    return F.transform(_all(c, HEADING, 1), bare)


def code_blocks(c) -> Column:
    """array<struct<language, code, length>>"""
    found = F.arrays_zip(_all(c, FENCE, 1).alias("language"), _all(c, FENCE, 2).alias("code"))
    return F.transform(found, lambda b: F.struct(F.when(b["language"] == "", "unknown").otherwise(b["language"]).alias("language"), b["code"].alias("code"), F.length(b["code"]).alias("length")))


def urls(c) -> Column:
    return F.array_sort(F.array_distinct(_all(c, URL)))


def email_count(c) -> Column:
    """How many addresses; the addresses are not kept."""
    return F.size(F.array_distinct(_all(c, EMAIL))).cast("long")


def versions(c) -> Column:
    return F.array_sort(F.array_distinct(_all(c, VERSION)))


def has_mark(c, mark: str) -> Column:
    return _c(c).rlike(rf"(?i)\b{mark}\b")


def tags(c) -> Column:
    found = F.flatten(F.array(*[_all(c, p, 1) for p in TAG_PATTERNS]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.lower), lambda t: F.length(t) > 2)))


def topics(c) -> Column:
    low = F.lower(_c(c))
    return F.array_compact(F.array(*[F.when(contains_any(low, n), F.lit(t)) for t, n in TOPICS.items()]))


def entities(c) -> Column:
    """File-like tokens, URLs and names before (): sorted, distinct."""
    calls = F.transform(_all(c, r"\b[a-zA-Z_][a-zA-Z0-9_]*\(\)"), lambda x: F.regexp_replace(x, r"\(\)", ""))
    return F.array_sort(F.array_distinct(F.flatten(F.array(_all(c, r"\b\w+\.\w+\b"), _all(c, r"https?://[^\s]+"), calls))))


def intent(c) -> Column:
    """The first intent one of whose phrases occurs; the order decides."""
    low, out = F.lower(_c(c)), F.lit("search")
    for name, phrases in reversed(INTENTS.items()):
        out = F.when(contains_any(low, phrases), name).otherwise(out)
    return out


def is_code_like(c) -> Column:
    return contains_any(c, CODE_MARKS)


def is_json_like(c) -> Column:
    t = F.trim(_c(c))
    return (F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}"))) | (F.startswith(t, F.lit("[")) & F.endswith(t, F.lit("]")))


def tokens_simple(c) -> Column:
    factor = F.when(is_code_like(c), 1.3).when(is_json_like(c), 1.2).otherwise(1.0)
    return F.floor(F.length(_c(c)) / 4.0 * factor).cast("long")


def tokens_detailed(c) -> Column:
    n, marks = F.regexp_count(_c(c), F.lit(WORD)), F.regexp_count(_c(c), F.lit(r"[^\p{L}\p{N}_\s]"))
    made = F.when(is_code_like(c), F.floor((n + marks) * 1.4)).when(is_json_like(c), F.floor((n + marks) * 1.3)).otherwise(n + F.floor(marks / 2))
    return F.when(F.length(_c(c)) == 0, 0).otherwise(F.greatest(made, F.lit(1))).cast("long")


def tokens_chunk(c) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(c)) / 4)).cast("long")


#: The blanks that SQL's trim takes off: Unicode's space separators.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def without_blanks(c) -> Column:
    return F.trim(_c(c), F.lit(BLANKS))


def snippet(c) -> Column:
    """First sentence of 10 to 150 characters, else the first 150 characters up to the last space."""
    short = F.filter(F.transform(F.split(_c(c), "[.!?]"), without_blanks), lambda s: (F.length(s) > 10) & (F.length(s) < 150))
    head = F.substring(_c(c), 1, 150)
    cut = F.when(F.length(_c(c)) > 150, F.concat(F.regexp_replace(head, r"[\t\n\f\r ][^\t\n\f\r ]*\z", ""), F.lit("..."))).otherwise(head)
    return F.coalesce(F.try_element_at(short, F.lit(1)), cut)


def jaccard(a, b) -> Column:
    """Of two arrays of distinct values; 0 if one is empty."""
    both, every = F.size(F.array_intersect(_c(a), _c(b))), F.size(F.array_union(_c(a), _c(b)))
    return F.when((F.size(_c(a)) == 0) | (F.size(_c(b)) == 0), 0.0).otherwise(both / every)


def html_to_text(c) -> Column:
    """Without script, style, comments and tags; the common entities; one space for white space, no empty lines."""
    out = F.regexp_replace(_c(c), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    out = F.regexp_replace(out, "<[^>]+>", "")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"\n\s*", "\n"))


def shorten(c) -> Column:
    """Gentle compaction: repeated lines go (first kept), white space collapses, long phrases become short."""
    keys = F.transform(lines(c), lambda x: F.lower(F.trim(x)))
    kept = F.filter(F.transform(lines(c), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.array_position(keys, F.lower(F.trim(s["x"]))) == s["i"] + 1)
    out = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"), r"\s+", " "))
    return reduce(lambda x, r: F.regexp_replace(x, rf"(?i)\b{r[0]}\b", r[1]), SHORTER, out)


def normalized_query(c, stop: list[str] = QUERY_STOP_WORDS) -> Column:
    parts = F.split(F.lower(F.trim(F.regexp_replace(_c(c), r"\s+", " "))), " ")
    return F.substring(F.array_join(F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(*stop)), " "), 1, 500)


def text_indicators(c) -> dict[str, Column]:
    """Counts and ratios that describe a text."""
    t = _c(c)
    w = F.filter(F.split(t, r"\s+"), lambda x: F.length(x) > 0)
    n = F.greatest(F.size(w), F.lit(1))
    by_dot = F.filter(F.transform(F.split(t, r"\."), lambda s: F.trim(s)), lambda s: F.length(s) > 0)
    size = F.greatest(F.length(t), F.lit(1))
    return {
        "sentence_count": F.size(by_dot).cast("long"),
        "line_count": F.size(lines(t)).cast("long"),
        "paragraph_count": F.size(F.split(t, "\n\n")).cast("long"),
        "has_punctuation": t.rlike("[.!?]"),
        "capital_ratio": F.round(F.regexp_count(t, F.lit(r"\p{Lu}")) / size, 6),
        "space_ratio": F.round(F.regexp_count(t, F.lit(r"\s")) / size, 6),
        "mean_word_length": F.round(F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n, 6),
        "unique_ratio": F.round(F.size(F.array_distinct(w)) / n, 6),
        "long_ratio": F.round(F.size(F.filter(w, lambda x: F.length(x) > 6)) / n, 6),
    }


def truncated(text: Column | str, most: Column | int, least: int = 50) -> Column:
    """At most `most` tokens (of four characters): back to the last end of a sentence if that lies beyond 70 %, else to the last blank beyond 80 %,
    with an ellipsis; null if less than `least` tokens would be left."""
    c = F.col(text) if isinstance(text, str) else text
    size = (F.lit(most) if isinstance(most, int) else most).cast("int") * 4
    head = F.substring(c, F.lit(1), size)
    dot = F.when(head.rlike("[.!?]"), F.length(F.regexp_replace(head, "(?s)[^.!?]*$", ""))).otherwise(0)
    blank = F.when(F.contains(head, F.lit(" ")), F.length(F.regexp_replace(head, "(?s)[^ ]*$", "")) - 1).otherwise(0)
    cut = F.when(dot > size * 0.7, F.substring(head, F.lit(1), dot)).when(blank > size * 0.8, F.concat(F.substring(head, F.lit(1), blank), F.lit("..."))).otherwise(head)
    return F.when(F.length(c) <= size, c).when(size >= 4 * least, cut)

"""Token counts without token ids.

A text falls into the pre-tokens of the vocabulary; a pre-token's pieces are counted by the library once, and a document's count is the
sum of frequency times pieces. Two passes over the texts:

1. every task tallies its most frequent pre-tokens; the most frequent of all (HOT at most) are counted and broadcast;
2. every document's frequencies are summed against the broadcast table in place; only pre-tokens outside it leave the task, as
   (document key, pre-token, frequency). They are dealt by pre-token, each distinct one is counted once, and frequencies join counts.

Frequent pre-tokens, which would make hot join keys, are exactly those that never reach the shuffle. The result does not depend on
which are hot. Pre-tokens longer than LONG characters hardly repeat: they are counted where they stand instead of being moved.

Pre-tokens of text below U+0300 (no combining marks, every character of a fixed class) come from the vocabulary's own split pattern,
spelled out for these characters. Runs between white space that hold other characters are normalised and split by the library.
Special strings inside a text are one token each, as the library counts them.

Cases: null and empty text count 0 tokens; repeated rows each keep their row; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, materialize, row_key, slices

VOCABULARY = "word_bpe_49k.json"
#: Pre-tokens in the broadcast table, in all and offered by one task; pre-tokens tallied at a time in a task, and runs remembered.
HOT, OFFERED, TALLIED, REMEMBERED = 400_000, 100_000, 600_000, 50_000
#: Characters of a pre-token that is counted where it stands.
LONG = 1000
LIMIT = 2048
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WHITE = re.compile(r"[^\S\x1c-\x1f]+")
_OTHER = re.compile("[^\x00-\u02ff]")


def _class(kind: str) -> str:
    return "".join(c for c in map(chr, range(0x300)) if unicodedata.category(c).startswith(kind))


#: The split pattern of the vocabulary, for lower-cased characters below U+0300 and what their lower case may hold.
_PLAIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_class('L')}]+|[{_class('N')}]|[^ \t\n\x0b\x0c\r\x85\xa0{_class('L')}{_class('N')}]+")


def runs(text: str) -> list[str]:
    """What stands between Unicode white space; the four information separators are not white space to the library."""
    if _SEPARATORS.search(text):
        return [u for u in _WHITE.split(text) if u]
    return text.split()


class Splitter:
    """Pre-tokens of texts, and the library's count of the pieces of one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        marks = self.library.get_added_tokens_decoder().values()
        if any(m.normalized or m.single_word or m.lstrip or m.rstrip for m in marks):
            raise ValueError("added tokens must be plain strings")
        self.special = re.compile("|".join(re.escape(m.content) for m in sorted(marks, key=lambda m: -len(m.content))) or r"(?!)")
        self.seen: dict[str, list[str]] = {}

    def of_run(self, run: str) -> list[str]:
        """Pre-tokens of a run with characters from U+0300 on."""
        found = self.seen.get(run)
        if found is None:
            whole = self.library.normalizer.normalize_str(run)
            found = [whole[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(whole)]
            if len(run) <= LONG:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[run] = found
        return found

    def split(self, text: str | None) -> tuple[Counter, int]:
        """How often each pre-token stands in the text, and the number of special strings."""
        out: Counter = Counter()
        if not text:
            return out, 0
        parts, special = [text], 0
        if "<" in text and self.special.search(text):
            parts = self.special.split(text)
            special = len(parts) - 1
        for part in parts:
            if not part.isascii() and _OTHER.search(part):
                plain = []
                for run in runs(part):
                    if run.isascii() or not _OTHER.search(run):
                        plain.append(run)
                    else:
                        out.update(self.of_run(run))
                part = " ".join(plain)
            part = part.lower()
            out.update(_PLAIN.findall(part) if len(part) < 1 << 20 else (m.group() for m in _PLAIN.finditer(part)))
        return out, special

    def pieces(self, unit: str) -> int:
        return sum(len(self.library.model.tokenize(p)) for p, _ in self.bytes.pre_tokenize_str(unit))


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def count_pieces(distinct: DataFrame, path: str) -> DataFrame:
    """distinct(unit) with `pieces`, the number of tokens the library makes of each pre-token."""

    def run(batches):
        s = splitter(path)
        for batch in slices(batches, 2000):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(s.pieces, batch.column(0).to_pylist()), pa.int32())], ["unit", "pieces"])

    return distinct.select("unit").mapInArrow(run, "unit string, pieces int")


def frequent_units(docs: DataFrame, path: str, text: str, top: int = HOT) -> DataFrame:
    """The most frequent pre-tokens of all texts, at most `top`: those whose tally is in the upper classes of a histogram."""

    def tally(batches):
        s, seen = splitter(path), Counter()
        for batch in slices(batches):
            for t in batch.column(0).to_pylist():
                seen.update(s.split(t)[0])
            if len(seen) > TALLIED:
                seen = Counter(dict(seen.most_common(TALLIED // 3)))
        offered = [x for x in seen.most_common(OFFERED) if len(x[0]) <= LONG]
        s.seen.clear()
        for at in range(0, len(offered), 10_000):
            part = offered[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["unit", "n"])

    offered = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(tally, "unit string, n long")
    offered = materialize(offered.groupBy("unit").agg(F.sum("n").alias("n")), "offered")
    level = F.floor(F.log2("n") * 8).cast("int")
    least, room = None, top
    for r in sorted(offered.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["level"]):  # some 500 rows
        if (room := room - r["k"]) < 0:
            break
        least = r["level"]
    return offered.where(F.lit(False) if least is None else level >= least).select("unit")


def token_counts(docs: DataFrame, path: str, carry: list[str], text: str = "text", doc_id: str = "doc_id", top: int = HOT) -> DataFrame:
    """The columns carry, n_bytes and n_tokens of every row."""
    spark = docs.sparkSession
    hot = count_pieces(frequent_units(docs, path, text, top), path).toArrow()  # at most `top` rows
    shared = spark.sparkContext.broadcast((hot["unit"].combine_chunks(), hot["pieces"].combine_chunks()))

    def split(batches):
        s, pieces = splitter(path), dict(zip(*(x.to_pylist() for x in shared.value), strict=True))
        for batch in slices(batches):
            k1, k2, unit, n = [], [], [], []
            for a, b, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, total = s.split(t)
                for u, f in found.items():
                    p = pieces.get(u)
                    if p is None and len(u) > LONG:
                        p = s.pieces(u)
                    if p is None:
                        k1.append(a), k2.append(b), unit.append(u), n.append(f)
                    else:
                        total += f * p
                k1.append(a), k2.append(b), unit.append(None), n.append(total)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(unit, pa.string()), pa.array(n, pa.int64())], [*KEY, "unit", "n"])
        s.seen.clear()  # workers outlive tasks

    keyed = docs.select(*carry, *row_key(text, doc_id), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    # Repeated rows share a key and add their sums again; `here` counts them.
    texts = docs.where(F.length(text) > 0).select(*row_key(text, doc_id), text)
    parts = texts.mapInArrow(split, "__k1 long, __k2 long, unit string, n long")
    dealt = parts.repartition(F.coalesce(F.col("unit"), F.col("__k1").cast("string")))
    counted = dealt.mapInArrow(_joined(path), "__k1 long, __k2 long, n long, here int")
    sums = counted.groupBy(*KEY).agg(F.expr("sum(n) div sum(here)").alias("n_tokens"))
    return keyed.join(sums, KEY, "left").select(*carry, "n_bytes", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))


def _joined(path: str):
    """Frequencies times pieces: all rows of a unit are in one task, which counts it once. `here` marks one row of each document."""

    def run(batches):
        s, pieces = splitter(path), {}
        for batch in slices(batches, 5000):
            unit = batch.column(2).to_pylist()
            new = list({u for u in unit if u is not None and u not in pieces})
            if len(pieces) > TALLIED:
                pieces.clear()
                new = list({u for u in unit if u is not None})
            pieces.update(zip(new, map(s.pieces, new)))
            n = [f if u is None else f * pieces[u] for u, f in zip(unit, batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([int(u is None) for u in unit], pa.int32())], [*KEY, "n", "here"])

    return run


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(VOCABULARY), ["doc_id"]).withColumn("over_limit", F.col("n_tokens") > LIMIT)

"""Looking a table of search terms up in texts where the texts are read: counts of whole words, alike words, phrases and wildcards.

Terms are few beside texts, so they are sent to the tasks. A task looks at a distinct word of its texts once and remembers which terms it
holds: whole words and literals by one automaton of all of them, alike words through the rarest letters of their letter sets. A phrase or
wildcard is tried on a text only if all its literals are in words of that text. What leaves a task is a row for each text and term that met.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.functions import text as T

#: What Spark's \s matches: white space between words. A line ends at \n.
_BLANKS = " \t\n\x0b\f\r"
#: Words, letter sets and paths that a task remembers at a time; texts whose words are looked up together.
MEMO, TEXTS = 200_000, 500
#: Letters in one number of a bit set.
BITS = 62


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


class Patterns:
    """Terms (number, term, wild) that are found anywhere in a text. In wild terms * is any characters of a line and ? is one."""

    def __init__(self, asked: list[tuple[int, str, bool]]):
        self.literal: dict[str, int] = {}
        self.keyed: dict[int, list[tuple]] = {}  # a term's longest literal -> its number, all its literals, what is left to test
        for number, term, wild in asked:
            parts = re.findall(f"[^{'*?' if wild else ''}{_BLANKS}]+", term)
            if parts:
                ids = frozenset(self.literal.setdefault(p, len(self.literal)) for p in parts)
                whole = (term.strip("*") if wild else term) == parts[0]
                test = None if whole else shaped(term) if wild else holds(term)
                self.keyed.setdefault(self.literal[max(parts, key=len)], []).append((number, ids, test))

    def found(self, text: str, held: set[int]) -> list[int]:
        """Numbers of the terms in a text whose words hold these literals."""
        return [number for one in held for number, ids, test in self.keyed.get(one, ()) if ids <= held and (test is None or test(text))]


def holds(term: str) -> Callable[[str], bool]:
    return lambda text: term in text


def shaped(term: str) -> Callable[[str], bool]:
    """Whether a line has the parts between stars behind each other, each as early as it can be."""
    parts = [re.compile("".join("." if c == "?" else re.escape(c) for c in part)) for part in term.split("*") if part]

    def line(text: str) -> bool:
        at = 0
        for part in parts:
            m = part.search(text, at)
            if not m:
                return False
            at = m.end()
        return True

    return lambda text: any(map(line, text.split("\n")))


class Alike:
    """Terms (number, term) whose letters have a Jaccard similarity over `least` with a word's. Sets that similar share one of their first
    letters in any fixed order; the order is by how many terms have a letter. A word's letters count as bits, those of no term by number."""

    def __init__(self, asked: list[tuple[int, str]], least: float):
        self.least, sets = least, {}
        for number, term in asked:
            sets.setdefault(frozenset(term), []).append(number)
        common = Counter(letter for own in sets for letter in own)
        self.letters = sorted(common, key=lambda c: (common[c], c))
        place = {c: k for k, c in enumerate(self.letters)}
        self.first: dict[tuple[int, int], list[tuple]] = {}  # first letter, size of the set -> sets and their terms
        for own, numbers in sets.items():
            for k in sorted(place[c] for c in own)[: self.prefix(len(own))]:
                self.first.setdefault((k, len(own)), []).append((sum(1 << place[c] for c in own), numbers))
        self.memo: dict[tuple[int, int], tuple] = {}

    def prefix(self, n: int) -> int:
        return max(n - math.ceil(n * self.least) + 1, 1)

    def near(self, n: int, own: int) -> tuple[tuple[int, float], ...]:
        out, rest = {}, own
        for _ in range(self.prefix(n) - (n - own.bit_count())):  # letters of no term are the rarest
            if not rest:
                break
            letter = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            for m in range(int(n * self.least), int(n / self.least) + 2):
                for other, numbers in self.first.get((letter, m), ()):
                    both = (own & other).bit_count()
                    share = both / (n + m - both)
                    if share > self.least:
                        out.update((number, share) for number in numbers)
        return tuple(out.items())

    def of(self, words: list[str]) -> Iterator[tuple[int, tuple]]:
        """Places of the words that are alike a term, with those terms."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        one = np.sort(np.repeat(np.arange(len(words)), size) << 21 | codepoints("".join(words)))
        one = one[np.diff(one, prepend=-1) != 0]  # each word's distinct letters
        word, code = one >> 21, one & ((1 << 21) - 1)
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        place = np.full(1 << 21, -1, np.int64)
        place[[ord(c) for c in self.letters]] = np.arange(len(self.letters))
        at = place[code]
        own = [0] * len(words)
        for k in range(0, len(self.letters), BITS):
            bits = np.where((at >= k) & (at < k + BITS), np.int64(1) << np.clip(at - k, 0, BITS), 0)
            part = np.bitwise_or.reduceat(bits, starts).tolist()
            own = [a | b << k for a, b in zip(own, part)] if k else part
        if len(self.memo) > MEMO:
            self.memo.clear()
        for w, key in enumerate(zip(np.diff(starts, append=len(one)).tolist(), own)):
            found = self.memo.get(key)
            if found is None:
                found = self.memo[key] = self.near(*key)
            if found:
                yield w, found


class Words:
    """What words hold of the terms: word -> whole words (number, times), alike terms (number, share), literals. Words that hold nothing are
    known, but not kept with the others. Words have no white space and are not empty."""

    def __init__(self, plain: dict[str, int], literal: dict[str, int], least: float):
        self.known: set[str] = set()
        self.holding: dict[str, tuple] = {}
        self.alike = Alike([(k, term) for term, k in plain.items()], least)
        self.letters = regex.compile(T.WORD).fullmatch
        terms = list({**plain, **literal})
        self.size = np.array([len(t) for t in terms], np.int64)
        self.number = np.array([plain.get(t, -1) if self.letters(t) else -1 for t in terms], np.int64)
        self.literal = np.array([literal.get(t, -1) for t in terms], np.int64)
        self.automaton = ahocorasick.Automaton()
        for k, term in enumerate(terms):
            self.automaton.add_word(term, k)
        self.automaton.make_automaton()

    def learn(self, words: set[str]) -> None:
        if len(self.known) > MEMO:
            self.known, self.holding = set(), {}
        fresh = list(words - self.known)
        self.known.update(fresh)
        if not fresh:
            return
        exact, near, literals = {}, dict(self.alike.of(fresh)), {}
        if len(self.automaton):
            line = "\n" + "\n".join(fresh) + "\n"
            end, what = np.fromiter(chain.from_iterable(self.automaton.iter(line)), np.int64).reshape(-1, 2).T
            blanks = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)) + 1)  # behind each word
            word = np.searchsorted(blanks, end)
            codes, kinds = np.unique(codepoints(line), return_inverse=True)
            letter = np.array([self.letters(chr(c)) is not None for c in codes.tolist()])[kinds]
            whole = (self.number[what] >= 0) & ~letter[end + 1] & ~letter[end - self.size[what]]
            for w, k in zip(word[whole].tolist(), self.number[what][whole].tolist()):
                exact.setdefault(w, Counter())[k] += 1
            held = self.literal[what] >= 0
            for w, k in zip(word[held].tolist(), self.literal[what][held].tolist()):
                literals.setdefault(w, set()).add(k)
        for w in exact.keys() | near.keys() | literals.keys():
            self.holding[fresh[w]] = (tuple(exact.get(w, {}).items()), near.get(w, ()), frozenset(literals.get(w, ())))


def hits(texts: DataFrame, terms: list[tuple[str, bool, bool]], least: float) -> DataFrame:
    """doc_id, number (of a term), tf, text, path, alike of texts(doc_id, text, path), all in lower case; a text and a term may have several
    rows, to be added. terms: term, plain, wild, in lower case. Plain terms are counted as whole words of the text; where there is none,
    alike is that of the most similar word. Others are found anywhere in the text; all are found anywhere in the path."""
    shared = texts.sparkSession.sparkContext.broadcast(terms)

    def scan(batches: Iterator[pa.RecordBatch]):
        asked = list(enumerate(shared.value))
        anywhere = Patterns([(k, term, wild) for k, (term, own, wild) in asked if not own])
        in_path = Patterns([(k, term, wild) for k, (term, _, wild) in asked])
        words = Words({term: k for k, (term, own, _) in asked if own}, anywhere.literal, least)
        path_words = Words({}, in_path.literal, least)
        find, paths = re.compile(f"[^{_BLANKS}]+").findall, {}

        def path_of(path: str) -> list[int]:
            if path not in paths:
                if len(paths) > MEMO:
                    paths.clear()
                parts = set(find(path))
                path_words.learn(parts)
                paths[path] = in_path.found(path, set().union(*(path_words.holding[x][2] for x in parts & path_words.holding.keys())))
            return paths[path]

        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            pairs = [(text or "", path or "") for text, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            counted = [Counter(find(text)) for text, _ in pairs]
            words.learn(set().union(*counted))
            # Rows of each kind, tf, text, path and alike: the text's place, the term's number, and the value.
            kinds = [([], [], []) for _ in range(4)]
            for r, ((text, path), counts) in enumerate(zip(pairs, counted, strict=True)):
                tf, near, literals = {}, {}, set()
                for word in counts.keys() & words.holding.keys():
                    exact, alike, held = words.holding[word]
                    for k, n in exact:
                        tf[k] = tf.get(k, 0) + n * counts[word]
                    for k, share in alike:
                        if share > near.get(k, 0.0):
                            near[k] = share
                    literals |= held
                near = {k: share for k, share in near.items() if k not in tf}
                found, there = anywhere.found(text, literals), path_of(path)
                for (places, numbers, values), some in zip(kinds, (tf, dict.fromkeys(found, 1), dict.fromkeys(there, 1), near), strict=True):
                    places += [r] * len(some)
                    numbers += some
                    values += some.values()
            if held := [r for places, _, _ in kinds for r in places]:
                columns, at = [pa.array([k for _, numbers, _ in kinds for k in numbers], pa.int32())], 0
                for (_, _, values), kind in zip(kinds, (np.int64, np.int32, np.int32, np.float64), strict=True):
                    column = np.zeros(len(held), kind)
                    column[at : at + len(values)] = values
                    columns.append(pa.array(column))
                    at += len(values)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held)), *columns], ["doc_id", "number", "tf", "text", "path", "alike"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text", "path").mapInArrow(scan, f"doc_id {kind}, number int, tf long, text int, path int, alike double")

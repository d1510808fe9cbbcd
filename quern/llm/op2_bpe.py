"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over all tokens finds, in one scan, every token that starts at each
byte of a piece. The encoder takes the longest first and backtracks where two neighbours are not compatible: two tokens may stand
side by side only if merging by rank would not have joined across their boundary, which is read off the merge history of both and
memoised by pair. A dead position is never tried again, so the work is linear, and the ids are those of rank-order merging.

Cases: null and empty text have no ids. Long texts are cut by the pattern into pieces of their own, handled a block at a time. A long
piece is scanned by windows: only the matches of the window in hand are held, beside some ten bytes for each byte of the piece, and a
window is scanned again only if backtracking returns to it. Repeated rows get equal rows; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import per_row

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids are kept at a time, longest piece that is kept, and pairs of tokens whose compatibility is kept.
MEMO_PIECES, MEMO_LENGTH, MEMO_PAIRS = 200_000, 64, 200_000
BLOCK = 1 << 16
#: Bytes of a piece whose matches are held at a time.
SPAN = 1 << 15
#: First bytes of a token by which the longest one is known.
HEAD = 3


class Pieces(dict):
    """Ids of pieces, as little-endian unsigned 32-bit bytes; those of short pieces are kept, and all forgotten when there are too many."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece.encode())
        ids = struct.pack(f"<{len(ids)}I", *ids) if len(ids) <= MEMO_LENGTH else np.asarray(ids, "<u4").tobytes()
        if len(piece) <= MEMO_LENGTH:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.ranks))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.memo = Pieces(self.encode_piece)
        #: Longest token that begins with these HEAD bytes; others are shorter.
        self.reach: dict[bytes, int] = {}
        for token in self.ranks:
            if len(token) >= HEAD:
                self.reach[token[:HEAD]] = max(self.reach.get(token[:HEAD], 0), len(token))

    def split(self, i: int) -> tuple[int, int] | None:
        """The two tokens that merge into token i last; None for a single byte or a token that merging never reaches."""
        if i not in self.halves:
            parts = [bytes([x]) for x in self.token[i]]
            while len(parts) > 2:
                best = min((self.ranks.get(a + b, i), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if best[0] >= i:
                    break
                k = best[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            self.halves[i] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[i]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves a boundary between a and b: undo their merges from the latest, looking at the pair that meets there."""
        pair = a << 20 | b
        known = self.fits.get(pair)
        if known is None:
            left, right, before, known = a, b, len(self.ranks) + 1, True
            while True:
                joined = self.ranks.get(self.token[left] + self.token[right])
                if joined is not None and joined < before:
                    known = False
                    break
                older_left, older_right = self.split(left), self.split(right)
                if older_left is None and older_right is None:
                    break
                # Between merges of one rank the left one comes first.
                if older_right is None or (older_left is not None and left > right):
                    before, left = left, older_left[1]
                else:
                    before, right = right + 1, older_right[0]
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            self.fits[pair] = known
        return known

    def matches(self, source: str, low: int, high: int) -> list[list[tuple[int, int]]]:
        """For each place from low to high the tokens that start there, as (id, size), shortest first."""
        starts: list[list[tuple[int, int]]] = [[] for _ in range(high - low)]
        for end, (i, size) in self.automaton.iter(source, low, min(len(source), high + self.longest - 1)):
            if end - size + 1 < high:
                starts[end - size + 1 - low].append((i, size))  # ends ascend, so lengths ascend
        return starts

    def encode_short(self, piece: bytes) -> list[int]:
        """What encode_piece gives: the same choices in the same order, but the tokens of a place are looked up as they are needed."""
        ranks, fits, reach = self.ranks, self.fits, self.reach
        n, at, last, ids, sizes, dead = len(piece), 0, -1, [], [], set()
        size = min(n, reach.get(piece[:HEAD], HEAD - 1))
        while at < n:
            while size:
                i = ranks.get(piece[at : at + size])
                if i is not None and (not dead or at + size not in dead):
                    fit = last < 0 or fits.get(last << 20 | i)
                    if fit is None:
                        fit = self.compatible(last, i)
                    if fit:
                        ids.append(i)
                        sizes.append(size)
                        last = i
                        at += size
                        size = reach.get(piece[at : at + HEAD], HEAD - 1)
                        if size > n - at:
                            size = n - at
                        break
                size -= 1
            else:  # no token fits after the one before: its place has its shorter ones, this one is closed
                dead.add(at)
                ids.pop()
                size = sizes.pop()
                at -= size
                size -= 1
                last = ids[-1] if ids else -1
        return ids

    def encode_piece(self, piece: bytes, span: int = SPAN) -> array | list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        if n <= min(MEMO_LENGTH, span):
            return self.encode_short(piece)
        source = piece.decode("latin-1")
        ids, sizes, left = array("I"), array("H"), array("H")  # left: how many choices of a place are still open
        at, dead, low, high = 0, bytearray(n + 1), 0, min(n, span)
        starts = self.matches(source, low, high)
        while at < n:
            if not low <= at < high:
                low = at - at % span
                high = min(n, low + span)
                starts = self.matches(source, low, high)
            choices = starts[at - low]
            taken = False
            while choices:
                i, size = choices.pop()  # what fails here is never tried at this place again
                if not dead[at + size] and (not ids or self.compatible(ids[-1], i)):
                    ids.append(i)
                    sizes.append(size)
                    left.append(len(choices))
                    at += size
                    taken = True
                    break
            if not taken:
                # No token fits after the one before: take that back. Its place has its other choices, this one is closed.
                dead[at] = 1
                ids.pop()
                at -= sizes.pop()
                open_ = left.pop()
                if not low <= at < high:
                    low = at - at % span
                    high = min(n, low + span)
                    starts = self.matches(source, low, high)
                del starts[at - low][open_:]
        return ids

    def ids_of(self, text: str):
        """Blocks of ids, as little-endian unsigned 32-bit bytes."""
        matches = (m.group() for m in self.find.finditer(text)) if len(text) > 1 << 20 else iter(self.find.findall(text))
        while block := list(islice(matches, BLOCK)):
            yield b"".join(map(self.memo.__getitem__, block))

    def encode(self, text: str | None) -> list[int]:
        return [i for block in self.ids_of(text or "") for i in np.frombuffer(block, "<u4").tolist()]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, carry: list[str], text: str = "text") -> DataFrame:
    """The columns carry and `ids array<int>` of every text."""

    def make():
        c = codec(path, pattern)

        def one(t):
            return (c.encode(t),)

        one.close = c.memo.clear  # workers outlive tasks
        return one

    return per_row(df, carry, text, "ids array<int>", make)


def decode(df: DataFrame, path: str, pattern: str, carry: list[str], ids: str = "ids") -> DataFrame:
    """The columns carry and `decoded binary` of every list of ids."""

    def make():
        c = codec(path, pattern)
        return lambda x: (c.decode(x or []),)

    return per_row(df, carry, ids, "decoded binary", make)


def digests(df: DataFrame, path: str, pattern: str, carry: list[str], text: str = "text") -> DataFrame:
    """The columns carry, n_tokens, and the SHA-256 of the ids and of what they decode to; no ids are kept."""

    def make():
        c = codec(path, pattern)

        def one(t):
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for block in c.ids_of(t or ""):
                ids.update(block)
                n += len(block) // 4
                for at in range(0, len(block), 4 * BLOCK):
                    decoded.update(c.decode(np.frombuffer(block[at : at + 4 * BLOCK], "<u4").tolist()))
            return n, ids.hexdigest(), decoded.hexdigest()

        one.close = c.memo.clear  # workers outlive tasks
        return one

    return per_row(df, carry, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, ["doc_id"])

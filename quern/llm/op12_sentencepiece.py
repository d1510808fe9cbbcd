"""SentencePiece encoding and decoding with the byte span of every piece.

Normalisation walks the text by the longest prefix that the model's compiled character map knows and copies a character where it knows
none; beside every character that it writes it records the byte of the original where the prefix began. Merging then works on segments
of the normalised text: a piece can only join two neighbours that stand side by side in some piece of the vocabulary, so the text is
cut, without any effect on the result, where no piece crosses. Segments are merged once, best score first and from the left on ties, and
memoised as ids and lengths; running sums of the lengths, looked up in the recorded alignment, project every piece onto bytes of
the original text. Characters that no piece has become byte pieces; the last of them has the character's span, those before are empty.

Cases: null and empty text have no ids. Text beyond BLOCK segments is handled a block at a time; a single segment (a run without blanks)
of n characters takes about 60 n bytes and n log n steps. Repeated rows get equal rows; other columns play no part. The
model must be of the BPE kind, with byte fallback and without user-defined or unused pieces, or a ValueError says so.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice, repeat
from operator import add

import numpy as np
from pyspark.sql import DataFrame

from .common import per_row

MODEL = "piece_bpe_32k.model"
#: Fixed values of the public model format: kinds of pieces and the mark of a blank.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BLANK = "▁"
#: Segments in hand, segments whose pieces a worker keeps from task to task (twice as many at most: some 200 MB), and the longest that is kept.
BLOCK, MEMO, MEMO_LENGTH = 1 << 16, 400_000, 48
#: Up to so many characters, neighbours are compared again after every merge; beyond, a heap holds them.
SHORT = 24
#: Stands for the rank of two neighbours that are no piece.
NONE = 1 << 62


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + size]
            at += size


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double-array trie over UTF-8 whose values are places in a list of zero-ended replacements."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64)
    texts, every, rules = blob[4 + size :], np.arange(1, 256), {}

    def base(node: int) -> int:
        return node ^ (int(units[node]) >> 10 << ((int(units[node]) & 512) >> 6))

    open_ = [(b"", base(0))]
    while open_:
        prefix, at = open_.pop()
        place = at ^ every
        place = np.where(place < len(units), place, 0)
        for label in every[(units[place] & 0x800000FF) == every].tolist():
            child = at ^ label
            below = base(child)
            if units[child] >> 8 & 1:
                start = int(units[below]) & 0x7FFFFFFF
                rules[(prefix + bytes([label])).decode()] = texts[start : texts.index(b"\0", start)].decode()
            open_.append((prefix + bytes([label]), below))
    return rules


class Model:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.load(f.read())

    def load(self, blob: bytes) -> None:
        pieces, trainer, normalizer = [], {}, {}
        for number, value in fields(blob):
            if number == 1:
                piece = dict(fields(value))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
            elif number == 5 and dict(fields(value)).get(2):
                raise ValueError("a model with a denormalizer is not supported")
        kinds = {k for _, _, k in pieces}
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces, are supported")
        self.suffix = bool(trainer.get(24, 0))
        self.prefix, self.squeeze, self.escape = (bool(normalizer.get(n, 1)) for n in (3, 4, 5))
        self.rules = character_map(normalizer.get(2, b""))
        self.by_first: dict[str, list[str]] = {}
        for source in sorted(self.rules, key=len, reverse=True):
            self.by_first.setdefault(source[0], []).append(source)
        self.special = re.compile("[" + re.escape("".join(sorted(self.by_first))) + "]") if self.by_first else None

        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.words = {p: i << 32 | len(p) for p, i in self.ids.items()}
        order = sorted({pieces[i][1] for i in self.ids.values()}, reverse=True)
        place = {score: r for r, score in enumerate(order)}
        self.rank = {p: place[pieces[i][1]] for p, i in self.ids.items() if len(p) > 1}
        self.bytes = [0] * 256
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes[int(p[1:-1], 16)] = i
        self.decimal = [str(i) for i in range(len(pieces))]
        mark = trainer.get(44, " ⁇ ".encode())
        shown = {NORMAL: lambda p: p.replace(BLANK, " ").encode(), UNKNOWN: lambda p: mark, CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[1:-1], 16)])}
        self.surface = [shown[k](p) for p, _, k in pieces]
        self.opens = np.array([k == NORMAL and p.startswith(BLANK) for p, _, k in pieces])
        self.is_control = np.array([k == CONTROL for _, _, k in pieces])
        self.is_byte = np.array([k == BYTE for _, _, k in pieces])

        # Characters of no longer piece stand alone. If no piece has a blank behind another character, segments end before blanks.
        within = set("".join(self.rank))
        letters = re.escape("".join(sorted(within - {BLANK})))
        if any(p[i] == BLANK and p[i - 1] != BLANK for p in self.rank for i in range(1, len(p))):
            self.segment = re.compile(f"[{letters}{BLANK}]+|.", re.S)
        else:
            self.segment = re.compile(f"{BLANK}+[{letters}]*|[{letters}]+|." if letters else f"{BLANK}+|.", re.S)
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    # ---- normalisation

    def steps(self, text: str) -> Iterator[tuple[str, int]]:
        """(what is written, bytes of the original it stands for) by longest known prefix; runs without a rule in one step."""
        at = 0
        while at < len(text):
            met = self.special.search(text, at) if self.special else None
            end = met.start() if met else len(text)
            if end > at:
                yield from ((c, len(c.encode())) for c in text[at:end])
            if not met:
                return
            known = next((s for s in self.by_first[text[end]] if text.startswith(s, end)), None)
            yield (text[end], len(text[end].encode())) if known is None else (self.rules[known], len(known.encode()))
            at = end + (1 if known is None else len(known))

    def normalized(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each place in it and its end, the byte of the original that it stands for."""
        blank = BLANK if self.escape else " "
        if not self.special and not self.squeeze and not self.suffix:
            out = text.replace(" ", blank)
            if text.isascii():
                starts = np.arange(len(text) + 1, dtype=np.int64)
            else:
                code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                starts = np.concatenate([[0], np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), dtype=np.int64)])
            return (blank + out, np.concatenate([[0], starts])) if self.prefix and text else (out, starts)
        steps, at = self.steps(text), 0
        written, places = [], array("q")
        after_blank = self.squeeze
        begun = False
        for shown, size in steps:
            if not begun:
                if self.squeeze and shown == " ":
                    at += size
                    continue
                begun = True
                if self.prefix and not self.suffix:
                    written.append(blank)
                    places.append(at)
            if after_blank:
                shown = shown.lstrip(" ")
            if shown:
                written.append(shown.replace(" ", blank))
                places.extend([at] * len(shown))
                after_blank = shown.endswith(" ")
            at += size
            if not self.squeeze:
                after_blank = False
        out, end = "".join(written), at
        if self.squeeze:
            short = out.rstrip(blank)
            if len(short) < len(out):
                end = places[len(short)]
                out, places = short, places[: len(short)]
        if begun and self.prefix and self.suffix:
            out += blank
            places.append(end)
        return out, np.array([*places, end], np.int64)

    # ---- merging

    def merged(self, segment: str) -> list[str]:
        """The pieces of a segment: neighbours join by best score, the left pair first on ties."""
        rank = self.rank
        n = len(segment)
        if n <= SHORT:
            parts, get = list(segment), rank.get
            pairs = list(map(get, map(add, segment, segment[1:]), repeat(NONE)))
            while pairs and (best := min(pairs)) < NONE:
                k = pairs.index(best)
                joined = parts[k] + parts[k + 1]
                parts[k : k + 2] = [joined]
                del pairs[k]
                if k < len(pairs):
                    pairs[k] = get(joined + parts[k + 1], NONE)
                if k:
                    pairs[k - 1] = get(parts[k - 1] + joined, NONE)
            return parts
        # end[i]: where the symbol that begins at i ends; begin[j]: where the symbol that ends at j begins; 0 or -1 where there is none.
        end, begin = array("q", range(1, n + 1)), array("q", range(-1, n))
        heap = [r * n + i for i in range(n - 1) if (r := rank.get(segment[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = end[i]
            if not j or j == n or rank.get(segment[i : end[j]]) != r:
                continue  # one of the two has merged otherwise
            k = end[j]
            end[i], end[j], begin[k] = k, 0, i
            if k < n and (r := rank.get(segment[i : end[k]])) is not None:
                heappush(heap, r * n + i)
            if i and (r := rank.get(segment[begin[i] : k])) is not None:
                heappush(heap, r * n + begin[i])
        out, i = [], 0
        while i < n:
            out.append(segment[i : end[i]])
            i = end[i]
        return out

    def coded(self, segment: str) -> bytes:
        """Ids and lengths of a segment's pieces as 64-bit words, id << 32 | length."""
        pieces = self.merged(segment)
        words = list(map(self.words.get, pieces))
        if None in words:
            words, known = [], words
            for piece, word in zip(pieces, known):
                spread = [self.bytes[b] << 32 for b in piece.encode()] if word is None else [word]
                words += spread if word is not None else [*spread[:-1], spread[-1] | 1]
        return array("Q", words).tobytes()

    def known(self, segment: str) -> bytes:
        """coded, from memory or after a cut wherever no piece holds the two characters side by side."""
        out = self.young.get(segment) or self.old.get(segment)
        if out is None:
            side_by_side = list(map(self.pairs.__contains__, map(add, segment, segment[1:])))
            if False in side_by_side:
                parts, at = [], 0
                for i, joined in enumerate(side_by_side, 1):
                    if not joined:
                        parts.append(self.known(segment[at:i]))
                        at = i
                out = b"".join([*parts, self.known(segment[at:])])
            else:
                out = self.coded(segment)
        if len(segment) <= MEMO_LENGTH:
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[segment] = out
        return out

    def blocks(self, text: str | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (ids, starts, ends): ids and byte spans of the pieces of a text."""
        if not text:
            return
        normal, places = self.normalized(text)
        at = 0
        found = (m.group() for m in self.segment.finditer(normal)) if len(normal) > 1 << 20 else iter(self.segment.findall(normal))
        while block := list(islice(found, BLOCK)):
            out = list(map(self.young.get, block))
            if None in out:
                out = [self.known(segment) if known is None else known for segment, known in zip(block, out)]
            words = np.frombuffer(b"".join(out), np.uint64)
            ids = (words >> np.uint64(32)).astype(np.int64)
            ends = at + np.cumsum(words & np.uint64(0xFFFFFFFF), dtype=np.int64)
            starts = np.concatenate([[at], ends[:-1]])
            at = int(ends[-1])
            yield ids, places[starts], places[ends]

    def encode(self, text: str | None) -> tuple[list[int], list[int], list[int]]:
        """Ids, and where each piece begins and ends in the UTF-8 bytes of the text."""
        out = [np.concatenate(x).tolist() for x in zip(*self.blocks(text))]
        return tuple(out) if out else ([], [], [])

    # ---- decoding

    def decode(self, ids, first: bool = True) -> str:
        """The text of ids. first: whether they begin the text, where the blank that normalisation put there is taken away."""
        ids = np.asarray(ids, np.int64)
        shown = list(map(self.surface.__getitem__, ids.tolist()))
        if first and (self.prefix or self.squeeze):
            for k, i in enumerate(ids.tolist()):
                if self.opens[i]:
                    shown[k] = shown[k][1:]
                    if self.squeeze and not shown[k]:
                        continue
                elif self.is_control[i]:
                    continue
                break
        try:
            if not self.is_control[ids].any():  # which part runs of bytes
                return b"".join(shown).decode()
        except UnicodeDecodeError:
            pass
        # Byte pieces that may be no valid text: each run is read by itself, and every byte that begins no character becomes a mark of its own.
        out, run = [], b""
        for i, part in zip(ids.tolist(), shown):
            if self.is_byte[i]:
                run += part
            else:
                out += [_lenient(run), part.decode()]
                run = b""
        return "".join(out) + _lenient(run)


def _lenient(run: bytes) -> str:
    out, at = [], 0
    while at < len(run):
        for size in range(1, 5):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


def encode(df: DataFrame, path: str, carry: list[str], text: str = "text") -> DataFrame:
    """The columns carry, `ids array<int>`, and the byte spans `starts array<long>`, `ends array<long>` of the pieces of every text."""

    def make():
        return model(path).encode

    return per_row(df, carry, text, "ids array<int>, starts array<long>, ends array<long>", make)


def decode(df: DataFrame, path: str, carry: list[str], ids: str = "ids") -> DataFrame:
    """The columns carry and `decoded string` of every list of ids."""

    def make():
        m = model(path)
        return lambda x: (m.decode(x or []),)

    return per_row(df, carry, ids, "decoded string", make)


def digests(df: DataFrame, path: str, carry: list[str], text: str = "text") -> DataFrame:
    """The columns carry, n_tokens, and SHA-256 of the ids (decimal, with commas), of what they decode to, and of the spans (start and end of
    each piece as little-endian 64-bit integers); no ids are kept."""

    def make():
        m = model(path)

        def one(t):
            n, ids, decoded, spans = 0, hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
            for numbers, starts, ends in m.blocks(t):
                ids.update(("," if n else "").encode() + ",".join(map(m.decimal.__getitem__, numbers.tolist())).encode())
                # A block ends where a segment ends, so its bytes are whole characters.
                decoded.update(m.decode(numbers, first=not n).encode())
                spans.update(np.stack([starts, ends], 1).astype("<i8").tobytes())
                n += len(numbers)
            return n, ids.hexdigest(), decoded.hexdigest(), spans.hexdigest()

        return one

    return per_row(df, carry, text, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", make)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(MODEL), ["doc_id"])

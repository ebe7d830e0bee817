"""SentencePiece encoding and decoding as shortest paths in a weighted finite-state transducer.

A model file compiles to three machines. The normaliser rewrites spaces to U+2581 and puts one before a text. The lexicon has an
arc for each piece; a character that no piece spells takes an arc to its bytes' pieces. The grammar weighs which piece may
follow which. Their composition with an input is expanded as it is searched, and the answer is its tropical shortest path.

For a unigram model a piece's arc costs its negative score and the grammar is free. For a byte-pair model merges, not scores,
decide: a sequence is the model's encoding exactly if every adjacent pair is the encoding of its own two pieces' text. The
grammar then costs nothing for such a pair and infinity for others, and one path of finite cost is left.

No piece holds U+2581 after another character, so a text's path is the paths of its words one after another; each distinct word
is searched once and texts are assembled from the memo.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import blocks, text_buffers
from .wordtable import Ragged, WordTable

SPACE = "▁"
#: Kinds of pieces and models in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: What a unigram path pays for an unknown character, below the least score.
UNKNOWN_PENALTY = 10.0


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        elif tag & 7 == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if tag & 7 == 5 else 8
            yield tag >> 3, data[at : at + size]
            at += size


class Machine:
    """The compiled transducer of a model file."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        trainer, normaliser = {}, {}
        for number, value in fields(model):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or trainer.get(24):
            raise ValueError("only unigram and byte-pair models with white space before words are supported")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(5, 1):
            raise ValueError("only models with the identity normaliser are supported")
        self.prefix = bool(normaliser.get(3, 1))
        self.lexicon = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
        self.longest = max(map(len, self.lexicon), default=1)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.unknown = kinds.index(UNKNOWN)
        self.fallback = len(self.bytes) == 256 and bool(trainer.get(35))
        self.spelt = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        after_letters = {a for p in self.lexicon for a, b in zip(p[1:], p, strict=False) if b.isascii() and b.isalpha()}
        if any(SPACE in p.lstrip(SPACE) for p in self.lexicon):
            raise ValueError("pieces cross words")
        self.breaks_lines = not any("\n" in p for p in self.lexicon)
        self.breaks_stops = self.kind == BPE and not after_letters & {".", ","}
        self.least = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The byte-pair encoding of a short text: the best-scored neighbours merge, the leftmost of equals, until none can."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                piece = self.lexicon.get(parts[i] + parts[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, left: str, right: str) -> bool:
        """Whether the byte-pair grammar lets ``right`` follow ``left``; at a word's start ``left`` is empty."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            known = self.merged(left + right) == ([left, right] if left else [right])
            self.pairs[left, right] = known
        return known

    def path(self, word: str) -> list[str]:
        """The output labels of the shortest path for one normalised word: pieces, or single characters that no piece spells."""
        return self._pair_path(word) if self.kind == BPE else self._scored_path(word)

    def _pair_path(self, word: str) -> list[str]:
        n, lexicon, pairs = len(word), self.lexicon, self.pairs
        last: list[str | None] = [None] * (n + 1)
        last[0] = ""
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                left = last[start]
                if left is None:
                    continue
                piece = word[start:end]
                if piece in lexicon or end - start == 1:
                    allowed = pairs.get((left, piece))
                    if allowed or allowed is None and self.follows(left, piece):
                        last[end] = piece
                        break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _scored_path(self, word: str) -> list[str]:
        n = len(word)
        cost, last = [0.0] + [np.inf] * n, [""] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                piece = self.lexicon.get(word[start:end])
                if piece is None and end - start > 1:
                    continue
                now = cost[start] - (self.least if piece is None else self.scores[piece])
                if now < cost[end]:
                    cost[end], last[end] = now, word[start:end]
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def labels(self, word: str) -> list[int]:
        """The path's ids, unspelt characters as bytes (or the unknown id, once for a run of them)."""
        out: list[int] = []
        for piece in self.path(word):
            if (i := self.lexicon.get(piece)) is not None:
                out.append(i)
            elif self.fallback:
                out += [self.bytes[b] for b in piece.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out


class Codec:
    """Encodes and decodes Arrow columns with one machine, through a memo of words."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.machine = Machine(f.read())
        self.words, self.ids = WordTable(2_000_000), Ragged()
        spelt = self.machine.spelt
        self.spelt = Ragged(np.uint8)
        self.spelt.extend(np.frombuffer(b"".join(spelt), np.uint8), np.array([len(x) for x in spelt], np.int64))

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of (rows, ids, ids of each row's part, the part's bytes with the prefix, bytes of each part)."""
        data, offsets = text_buffers(column)
        for begin, end, rows, starts in blocks(data, offsets):
            stops = np.append(starts[1:], end)
            heads = (starts == offsets[rows]) & (stops > starts) & self.machine.prefix
            text = np.insert(data[begin:end], (starts - begin)[heads], 32)
            shift = np.cumsum(heads)
            at = starts - begin + shift - heads
            first, stop = self._words(text, at)
            index, new, cleared = self.words.indices(text, first, stop)
            if cleared:
                self.ids.clear()
            if new:
                found = [np.array(self.machine.labels(w.decode().replace(" ", SPACE)), np.uint32) for w in new]
                self.ids.extend(np.concatenate(found), np.array([len(x) for x in found], np.int64))
            ids, per_word = self.ids.take(index)
            bounds = np.append(at, len(text))
            sums = np.concatenate([[0], np.cumsum(per_word)])
            yield rows, ids, np.diff(sums[np.searchsorted(first, bounds, "left")]), text, np.diff(bounds)

    def _words(self, text: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end: at a run of spaces, around line feeds, at a row's start, before a stop that ends a word."""
        if not len(text):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = text == 32
        mark = np.zeros(len(text), bool)  # U+2581 itself counts as a space before one
        mark[2:] = (text[2:] == 0x81) & (text[1:-1] == 0x96) & (text[:-2] == 0xE2)
        begins = space.copy()
        begins[1:] &= ~(space | mark)[:-1]
        line = text == 10
        if self.machine.breaks_lines:
            begins |= line
            begins[1:] |= line[:-1]
        row = np.zeros(len(text) + 1, bool)
        row[row_starts] = True
        if self.machine.breaks_stops:
            letter = (text | 32) - 97 < 26
            stops = np.flatnonzero((text == ord(".")) | (text == ord(",")))
            stops = stops[stops > 0]
            after = np.append(space | line, True) | row
            begins[stops[after[stops + 1] & letter[stops - 1] & ~row[stops]]] = True
        begins |= row[:-1]
        begins[0] = True
        first = np.flatnonzero(begins)
        return first, np.append(first[1:], len(text))

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids spell, still with the prefix, and how many each spells."""
        return self.spelt.take(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text, however long; null texts count as empty and have no ids.

    Repeated rows and null ids stay, other columns are not looked at, an empty table gives no rows.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path)
        for batch in batches:
            ids, counts = [np.zeros(0, np.uint32)], np.zeros(len(batch), np.int64)
            for rows, part, n, *_ in of.encode(batch.column(1)):
                ids.append(part)
                np.add.at(counts, rows, n)
            flat = np.concatenate(ids).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(made, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of ids; null ids count as none. Bytes that form no character become U+FFFD.

    Repeated rows stay, other columns are not looked at, an empty table gives no rows.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                data = of.decode(np.array(ids or [], np.int64))[0].tobytes().decode(errors="replace")
                texts.append(data[1:] if of.machine.prefix and data[:1] == " " else data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return tokens.select(id_col, ids_col).mapInArrow(made, f"`{id_col}` {tokens.schema[id_col].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_crc32, decoded_bytes, decoded_crc32, round_trip): each text encoded, and decoded again from its ids.

    ids_crc32 is over little-endian unsigned 32-bit ids. Null texts count as empty; repeated rows and null ids stay. A text
    holding U+2581 decodes to a space there and isn't a round trip, as with the library. Texts are taken in blocks, so their length
    doesn't matter; other columns are not looked at, an empty table gives no rows.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(path)
        for batch in batches:
            n = len(batch)
            tokens, size, ids_crc, crc, same = *np.zeros((4, n), np.int64), np.ones(n, bool)
            for rows, ids, counts, text, sizes in of.encode(batch.column(1)):
                back, per_id = of.decode(ids.astype(np.int64))
                id_ends, text_ends = np.cumsum(counts), np.cumsum(sizes)
                back_ends = np.concatenate([[0], np.cumsum(per_id)])[id_ends]
                whole, a, c, d = ids.astype("<u4", copy=False), 0, 0, 0
                for r, b, e, f in zip(rows.tolist(), id_ends.tolist(), back_ends.tolist(), text_ends.tolist(), strict=True):
                    skip = 1 if of.machine.prefix and not size[r] and e > c else 0
                    part = back[c + skip : e]
                    same[r] &= e - c == f - d and back[c:e].data == text[d:f].data
                    ids_crc[r], crc[r] = zlib.crc32(whole[a:b], int(ids_crc[r])), zlib.crc32(part, int(crc[r]))
                    tokens[r] += b - a
                    size[r] += len(part)
                    a, c, d = b, e, f
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (tokens, ids_crc, size, crc, same))], names=[id_col, "n_tokens", "ids_crc32", "decoded_bytes", "decoded_crc32", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(made, f"`{id_col}` {kind}, n_tokens long, ids_crc32 long, decoded_bytes long, decoded_crc32 long, round_trip boolean")

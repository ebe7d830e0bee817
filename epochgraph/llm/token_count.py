"""Exact token counts of whole texts by overlapping chunks that are spliced where both sides provably agree.

A text is encoded chunk by chunk with offsets, each chunk overlapping the one before; one of a single chunk needs no splice. The
chunks of a whole batch are encoded together. A position is stable if no token of any of the known tokenizer kinds can cross it and no context
beyond it changes the tokens on either side: before a single space between two letters, or before a single line feed between two
visible characters. Two chunks are spliced at a stable position of their overlap where, up to a later stable position, both gave
the same tokens. A text in which some chunks don't align is taken anew, and there overlaps are widened, in the end to all of the earlier
chunk, which is then replaced by a longer one.

Null texts count as empty, repeated rows stay, null ids pass through, and other columns of the input are not looked at.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .tokens import WordEncoder, drops_white_space

CHUNK_CHARS = 4096
OVERLAP_CHARS = 256
#: Characters of text that are encoded together.
STEP = 1 << 19

#: Ids, and the characters at which each token begins and ends.
Encoded = tuple[np.ndarray, np.ndarray, np.ndarray]


@lru_cache(maxsize=1)
def _stable_pattern():
    import regex

    return regex.compile(r"(?<=\p{L})(?= \p{L})|(?<=\S)(?=\n\S)")


def stable_positions(text: str, low: int, high: int) -> list[int]:
    """Stable positions p with low < p < high, judged from characters inside [low, high)."""
    return [m.start() for m in _stable_pattern().finditer(text, low, high) if low < m.start() < high]


def splice_position(text: str, left: Encoded, right: Encoded, low: int, high: int) -> int | None:
    """A stable position in [low, high), the overlap, up to which ``left`` and from which ``right`` holds; None if they don't align."""
    points = stable_positions(text, low, high)
    if len(points) < 2:
        return None
    begin, end = points[(len(points) - 1) // 2], points[-1]
    inside = []
    for ids, starts, ends in (left, right):
        for p in (begin, end):
            if ((starts < p) & (ends > p)).any():
                return None
        inside.append(ids[(starts >= begin) & (ends <= end)])
    return begin if np.array_equal(*inside) else None


def resynchronised(text: str, encode: Callable[[str], Encoded], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[np.ndarray]:
    """The ids of a text of any length, in parts, from overlapping chunks."""

    def encoded(begin: int, end: int) -> Encoded:
        ids, starts, ends = encode(text[begin:end])
        return ids, starts + begin, ends + begin

    begin, end, since = 0, min(chunk, len(text)), 0
    current = encoded(begin, end)
    while end < len(text):
        width, at = overlap, None
        while at is None:
            low = max(begin, end - width)
            high = min(low + max(chunk, 2 * (end - low)), len(text))
            following = encoded(low, high)
            at = since if low == begin else splice_position(text, current, following, max(low, since), end)
            width *= 2
        ids, starts, ends = current
        if low > begin:
            yield ids[(starts >= since) & (ends <= at)]
        begin, end, since, current = low, high, at, following
    ids, starts, _ = current
    yield ids[starts >= since]


def chunks(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Begin and end of each chunk of a text of n characters."""
    last = max(0, -(-(n - chunk) // (chunk - overlap)))
    return [(k * (chunk - overlap), min(n, k * (chunk - overlap) + chunk)) for k in range(last + 1)]


def spliced(text: str, bounds: list[tuple[int, int]], parts: list[Encoded]) -> int | None:
    """How many tokens a text has by its encoded chunks; None if two of them don't align."""
    total = since = 0
    for k, (low, _) in enumerate(bounds):
        ids, starts, ends = parts[k]
        at = None
        if k + 1 < len(bounds):
            begin, end = bounds[k + 1][0], bounds[k][1]
            ahead = (parts[k + 1][0], parts[k + 1][1] + begin, parts[k + 1][2] + begin)
            at = splice_position(text, (ids, starts + low, ends + low), ahead, max(begin, since), end)
            if at is None:
                return None
        total += int(((starts + low >= since) & (at is None or ends + low <= at)).sum())
        since = at
    return total


class Counter:
    """Counts by one vocabulary file: a tokenizers .json or a sentencepiece .model."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.chunk, self.overlap = chunk, overlap
        if drops_white_space(path):
            self._encode = WordEncoder(path).encode_with_spans
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [_proto(model, text) for text in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda texts: [_offsets(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text; the texts of about STEP characters are worked on together."""
        out, held, size = np.zeros(len(column), np.int64), [], 0
        for i, text in enumerate(column.to_pylist()):
            held.append((i, text or ""))
            size += len(text or "")
            if size >= STEP:
                self._add(held, out)
                held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, str]], out: np.ndarray) -> None:
        bounds = [chunks(len(text), self.chunk, self.overlap) for _, text in held]
        parts = iter(self._encode([text[a:b] for (_, text), of in zip(held, bounds, strict=True) for a, b in of]))
        for (i, text), of in zip(held, bounds, strict=True):
            n = spliced(text, of, [next(parts) for _ in of])
            out[i] = sum(len(x) for x in resynchronised(text, lambda t: self._encode([t])[0], self.chunk, self.overlap)) if n is None else n


def _offsets(e) -> Encoded:
    spans = np.array(e.offsets, np.int64).reshape(-1, 2)
    return np.array(e.ids, np.uint32), spans[:, 0], spans[:, 1]


def _proto(model, text: str) -> Encoded:
    pieces = model.encode(text, return_type="proto").pieces
    spans = np.array([(p.begin, p.end) for p in pieces], np.int64).reshape(-1, 2)
    leads = (np.frombuffer(text.encode() + b" ", np.uint8) & 0xC0) != 0x80  # the library counts bytes
    spans = (np.cumsum(leads) - 1)[spans]
    return np.array([p.id for p in pieces], np.uint32), spans[:, 0], spans[:, 1]


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> Counter:
    """One for each Python worker, so that its memo serves all tasks there."""
    return Counter(path, chunk, overlap)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; no shuffle, and memory is bounded by one Arrow batch and the memo.

    Null texts count as empty, without bytes or tokens; a text of any length is counted whole, by chunks. Repeated rows and null ids
    stay, other columns are not looked at, an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(path, chunk, overlap)
        for batch in batches:
            text = batch.column(1)
            n = pa.array(of.counts(text), pa.int64())
            n_bytes = pa.compute.binary_length(text).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n, pa.compute.greater(n, limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

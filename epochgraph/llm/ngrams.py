"""Hashed byte n-grams of texts: counts for training, and linear scores of whole texts without building the counts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, text_buffers

BUCKETS = 1 << 14
ORDERS = (2, 3, 4)
#: Bytes of text that one step scores, so that its arrays stay in the CPU's cache.
SCORE_BYTES = 1 << 16
_SALT = np.random.default_rng(7).integers(0, 1 << 31, (4, 256), np.int32)

#: Letters alone, A to Z lowered; all else is white space. Bytes of other scripts count as letters.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[:128] = 32
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)
#: Everything but white space as it stands, digits alike.
SIGNS = np.arange(256, dtype=np.uint8)
SIGNS[[9, 10, 11, 12, 13]] = 32
SIGNS[48:58] = 48


def buckets(data: np.ndarray, stops: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the bucket of the n-gram at each byte; BUCKETS or more where it leaves its text or has white space inside."""
    space = (data == 32).astype(np.int32) * BUCKETS
    hashed = _SALT[0][data]
    for n in range(2, max(ORDERS) + 1):
        hashed = hashed[: len(data) - n + 1] ^ _SALT[n - 1][data[n - 1 :]]
        if n not in ORDERS:
            continue
        inside = [space[k : k + len(hashed)] for k in range(1, n - 1)]
        out = np.full(len(data), BUCKETS, np.int32)
        own = out[: len(hashed)]
        np.bitwise_and(hashed ^ n * 0x9E3779B, BUCKETS - 1, out=own)
        own |= reduce(np.bitwise_or, inside) if inside else space[: len(hashed)] & space[1 : 1 + len(hashed)]
        for k in range(1, n):
            last = stops - k
            out[last[last >= 0]] = BUCKETS
        yield out


def _steps(column: pa.Array, table: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Blocks of (rows, where their parts begin, the bounds of the parts, the buckets for each order).

    A long row's parts are cut before white space; the byte behind a cut still belongs to the n-grams that begin before it.
    """
    data, offsets = text_buffers(column)
    for begin, end, rows, starts in blocks(data, offsets, size):
        if end > begin:
            more = min(end + 1, int(offsets[rows[-1] + 1])) - end
            found = buckets(table[data[begin : end + more]], np.append(starts[1:], end + more) - begin)
            yield rows, starts - begin, np.append(starts[1:], end) - begin, [x[: end - begin] for x in found]


def counts(column: pa.Array, table: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(bucket ids as uint16, shares as float32) of each text: the shares of its n-grams that fall into each bucket."""
    sums: dict[int, np.ndarray] = {}
    out = []
    for rows, starts, stops, found in _steps(column, table, BLOCK_BYTES):
        for r, a, b in zip(rows.tolist(), starts.tolist(), stops.tolist(), strict=True):
            sums[r] = sums.get(r, 0) + np.bincount(np.concatenate([x[a:b] for x in found]), minlength=BUCKETS)[:BUCKETS]
    for r in range(len(column)):
        seen = sums.get(r, np.zeros(BUCKETS))
        ids = np.flatnonzero(seen)
        out.append((ids.astype(np.uint16).tobytes(), (seen[ids] / max(1, seen.sum())).astype(np.float32).tobytes()))
    return out


def scores(column: pa.Array, table: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight row (BUCKETS x classes) over all n-grams of each text; zeros where there are none."""
    classes = np.zeros((weights.shape[1], 2 * BUCKETS), np.float32)  # what isn't counted weighs nothing
    classes[:, :BUCKETS] = weights.T
    out, n = np.zeros((len(column), len(classes))), np.zeros(len(column))
    for rows, starts, stops, found in _steps(column, table, SCORE_BYTES):
        full = stops > starts
        rows, starts = rows[full], starts[full]
        for k, of in enumerate(classes):
            out[rows, k] += np.add.reduceat(reduce(np.add, (of.take(x) for x in found)), starts, dtype=np.float64)
        n[rows] += np.add.reduceat(reduce(np.add, ((x < BUCKETS).view(np.uint8) for x in found)), starts, dtype=np.int64)
    return out / np.maximum(n, 1)[:, None]


class Sample:
    """Bucket shares of many texts, as flat arrays in narrow types: the driver holds them while it trains."""

    def __init__(self, rows: list[tuple[bytes, bytes]]):
        ids, shares = [np.frombuffer(r[0], np.uint16) for r in rows], [np.frombuffer(r[1], np.float32) for r in rows]
        self.size = np.array([len(x) for x in ids], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        self.shares = np.concatenate(shares) if shares else np.zeros(0, np.float32)

    def add(self, rows: list[tuple[bytes, bytes]]) -> None:
        """Further texts, behind the others."""
        more = Sample(rows)
        self.start = np.concatenate([self.start, self.start[-1] + more.start[1:]])
        self.size, self.ids, self.shares = (np.concatenate([getattr(self, c), getattr(more, c)]) for c in ("size", "ids", "shares"))

    def squares(self) -> np.ndarray:
        """The sum of squared shares of each bucket."""
        return np.bincount(self.ids, self.shares * self.shares, BUCKETS)

    def parts(self, first: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of ``size`` rows from ``first`` on: (row, row after the last, buckets, shares), without copies."""
        for a in range(first, len(self.size), size):
            b = min(a + size, len(self.size))
            yield a, b, self.ids[self.start[a] : self.start[b]], self.shares[self.start[a] : self.start[b]]

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position among ``rows``, bucket and share of every entry of these rows."""
        size = self.size[rows]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32) + np.repeat((self.start[rows] - (ends - size)).astype(np.int32), size)
        return np.repeat(np.arange(len(rows), dtype=np.int32), size), self.ids[at], self.shares[at]

    def times(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Each row's shares times a weight matrix (BUCKETS x k)."""
        out = np.zeros((len(rows), weights.shape[1]))
        for a in range(0, len(rows), 256):
            row, bucket, share = self.of(rows[a : a + 256])
            for k in range(weights.shape[1]):
                out[a : a + 256, k] = np.bincount(row, share * weights[bucket, k], len(rows[a : a + 256]))
        return out


def share_hashed(docs: DataFrame, key, n: int) -> "F.Column":
    """A condition that holds for about ``n`` distinct values of ``key``, chosen by their hashes, over all rows alike."""
    hashed = F.xxhash64(key, F.lit("sample"))
    distinct = docs.agg(F.approx_count_distinct(key, 0.02)).first()[0] or 1
    return F.shiftrightunsigned(hashed, 1) < F.lit(min(2**63 - 1, int(2**63 * n / distinct)))

"""A memo from words to dense indices whose look-ups are vectorised over a block of text.

Python dictionaries cost several hundred nanoseconds a word once they outgrow the CPU cache. Here every word of a block is
hashed at once from prefix sums, and probes an open-addressing table in numpy. Two 64-bit hashes from independent random byte codes
identify a word.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

from .common import BLOCK_BYTES

#: Longer words are hashed by a cryptographic digest, as modular polynomials are weak on long periodic strings.
LONG_WORD = 64


class WordTable:
    """Indices are dense and in order of first sight; past ``limit`` words the table starts afresh to bound memory."""

    def __init__(self, limit: int = 1_500_000):
        rng = np.random.default_rng(20240229)
        self.limit = limit
        self.code = rng.integers(0, 2**64, (2, 256), np.uint64)
        odd = int(rng.integers(0, 2**63)) * 2 + 1
        self._grow_powers(odd, 2 * BLOCK_BYTES + 2)
        self.clear()

    def _grow_powers(self, odd: int, n: int) -> None:
        self.odd = odd
        self.power = _powers(odd, n)
        self.inverse = _powers(pow(odd, -1, 2**64), n)

    def clear(self) -> None:
        self.size = 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.first = np.zeros(1 << 15, np.uint64)
        self.second = np.zeros(1 << 15, np.uint64)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: int = 2) -> list[np.ndarray]:
        """``of`` hashes (at most two) for each word data[start:end]; words are in order and don't overlap."""
        if len(self.power) <= len(data):
            self._grow_powers(self.odd, len(data) + 1)
        out = []
        for code in self.code[:of]:
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(code[data] * self.power[: len(data)], out=sums[1:])
            out.append(_mixed((sums[ends] - sums[starts]) * self.inverse[starts]))
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16).digest()
            for hashed, value in zip(out, np.frombuffer(digest, np.uint64), strict=False):
                hashed[i] = value
        return out

    def indices(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes], bool]:
        """Index of each word, the words that are new (they got the next indices in this order), and if the table was cleared."""
        if cleared := self.size > self.limit:
            self.clear()
        first, second = self.hashes(data, starts, ends)
        found = self._probe(first, second)
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return found, [], cleared
        order = missing[np.lexsort((second[missing], first[missing]))]
        fresh = np.ones(len(order), bool)  # where a run of equal words begins
        fresh[1:] = (first[order[1:]] != first[order[:-1]]) | (second[order[1:]] != second[order[:-1]])
        new = order[fresh]
        self._insert(first[new], second[new])
        found[order] = self.size - len(new) + np.cumsum(fresh) - 1
        raw = data.tobytes()
        return found, [raw[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)], cleared

    def _home(self, first: np.ndarray) -> np.ndarray:
        return (first >> np.uint64(64 - self.slots.size.bit_length() + 1)).astype(np.int64)

    def _probe(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.full(len(first), -1, np.int64)
        todo, at = np.arange(len(first)), self._home(first)
        while len(todo):
            held = self.slots[at]
            full = held >= 0
            todo, at, held = todo[full], at[full], held[full]
            same = (self.first[held] == first[todo]) & (self.second[held] == second[todo])
            out[todo[same]] = held[same]
            todo, at = todo[~same], (at[~same] + 1) & (self.slots.size - 1)
        return out

    def _insert(self, first: np.ndarray, second: np.ndarray) -> None:
        total = self.size + len(first)
        if total > len(self.first):
            room = max(total, 2 * len(self.first))
            self.first, self.second = (np.concatenate([x[: self.size], np.zeros(room - self.size, np.uint64)]) for x in (self.first, self.second))
        self.first[self.size : total], self.second[self.size : total] = first, second
        if 2 * total > self.slots.size:
            while 2 * total > self.slots.size:
                self.slots = np.empty(2 * self.slots.size, np.int32)
            self.slots[:] = -1
            self._place(np.arange(total))
        else:
            self._place(np.arange(self.size, total))
        self.size = total

    def _place(self, index: np.ndarray) -> None:
        at = self._home(self.first[index])
        while len(index):
            free = self.slots[at] < 0
            self.slots[at[free]] = index[free]  # of several for one slot the last stays
            lost = self.slots[at] != index
            index, at = index[lost], (at[lost] + 1) & (self.slots.size - 1)


class Ragged:
    """Variable-length integer values, stored flat, that grow at the end."""

    def __init__(self, dtype=np.uint32):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.start, self.count, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def extend(self, flat: np.ndarray, counts: np.ndarray, order: np.ndarray | None = None) -> None:
        """Add entries of these sizes; their values stand in ``flat`` in the given order of entries."""
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(len(self.flat) + len(flat), self.dtype)])
        if self.n + len(counts) > len(self.start):
            room = np.zeros(len(self.start) + len(counts), np.int64)
            self.start, self.count = np.concatenate([self.start[: self.n], room]), np.concatenate([self.count[: self.n], room])
        self.flat[self.used : self.used + len(flat)] = flat
        if order is None:
            self.start[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        else:
            self.start[self.n + order] = self.used + np.cumsum(counts[order]) - counts[order]
        self.count[self.n : self.n + len(counts)] = counts
        self.used, self.n = self.used + len(flat), self.n + len(counts)

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of these entries one after another, and how many each has."""
        counts = self.count[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.start[index] - (ends - counts), counts)], counts


@lru_cache(maxsize=4)  # tables of one worker share them
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x

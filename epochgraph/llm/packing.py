"""Packing of documents into token sequences of a fixed capacity, by linear grouping and best fit, planned on length counts only.

Pieces have at most ``capacity`` tokens, so the histogram of piece lengths has at most ``capacity`` rows however many documents
there are; only it goes to the driver. The plan is made on it in four steps:

1. Large lengths are split into groups of equal cardinality and rounded up to their group's greatest.
2. For these few sizes the configurations of a sequence are optimised: a linear program by column generation, rounded down.
3. Actual lengths take the places of the rounded ones, group by group, so that the exact free space is known again.
4. What the rounding left over, then the small lengths, go best-fit into the free space, in decreasing length.

The plan is a list of segments: "ranks r.. of length L go to sequences s.., k in each, from this offset". Segments number a
small multiple of the capacity, whatever the input. Workers place a piece from its rank among pieces of its length; ranks come
from counts by (task, length), so nothing is sorted and no length is gathered in one place.
"""

from __future__ import annotations

import os
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .tokens import WordEncoder

CAPACITY = 4096
SEPARATOR = 1
#: Lengths over capacity / LARGE are large; they are rounded to at most GROUPS sizes.
LARGE, GROUPS = 3, 32


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def document_pieces(column: pa.Array, of: WordEncoder, capacity: int, separator: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, piece, start, length, crc32 of the ids) of the texts, each followed by the separator."""
    end = np.array([separator], np.uint32)
    row, piece, rest = -1, 0, end[:0]

    def finished() -> Iterator[tuple[int, int, int, int, int]]:
        if row >= 0:
            yield from cut(row, piece, np.concatenate([rest, end]), capacity, all_of=True)

    for rows, ids, counts in of.encode(column):
        stops = np.cumsum(counts)
        for r, a, b in zip(rows.tolist(), (stops - counts).tolist(), stops.tolist(), strict=True):
            if r != row:
                yield from finished()
                row, piece, rest = r, 0, end[:0]
            rest = np.concatenate([rest, ids[a:b]]) if len(rest) else ids[a:b]
            if len(rest) > capacity:
                for x in cut(row, piece, rest, capacity, all_of=False):
                    piece += 1
                    yield x
                rest = rest[(len(rest) // capacity) * capacity :]
    yield from finished()


def cut(row: int, piece: int, ids: np.ndarray, capacity: int, all_of: bool) -> Iterator[tuple[int, int, int, int, int]]:
    for a in range(0, len(ids) if all_of else len(ids) - len(ids) % capacity, capacity):
        part = ids[a : a + capacity]
        yield row, piece, piece * capacity, len(part), zlib.crc32(part.astype("<u4", copy=False).data)
        piece += 1


def pieces_of(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, separator: int) -> DataFrame:
    """One row a piece, with the task that made it and its rank among that task's pieces of its length."""
    kind = docs.schema[id_col].dataType

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            found = np.array(list(document_pieces(batch.column(1), of, capacity, separator)), np.int64).reshape(-1, 5)
            length = found[:, 3]
            order = np.argsort(length, kind="stable")
            kinds, first, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(found), np.int64)
            rank[order] = np.arange(len(found)) - np.repeat(first, n) + np.repeat(seen[kinds], n)
            seen[kinds] += n
            columns = [batch.column(0).take(pa.array(found[:, 0])), pa.array(found[:, 1].astype(np.int32)), *(pa.array(found[:, i]) for i in (2, 3, 4)), pa.array(np.full(len(found), task)), pa.array(rank)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32", "task", "rank_in_task"])

    return docs.select(id_col, text_col).mapInArrow(made, f"`{id_col}` {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, task long, rank_in_task long")


class Plan:
    """Segments (length, first rank, sequences, first sequence, pieces in each, offset) and the number of sequences."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS):
        self.capacity, self.sequences = capacity, 0
        self.left = dict(sorted(counts.items(), reverse=True))
        self.given = dict.fromkeys(self.left, 0)
        self.segments: list[tuple[int, int, int, int, int, int]] = []
        self.free: list[tuple[int, int, int]] = []  # (free tokens, first sequence, sequences), sorted
        sizes = [s for s in self.left if s * large > capacity]
        if sizes:
            self._configure(sizes, groups)
        for size in self.left:
            self._best_fit(size)

    def _open(self, n: int) -> int:
        first = self.sequences
        self.sequences += n
        return first

    def _place(self, size: int, n: int, first: int, each: int, free: int) -> None:
        """``each`` pieces of this size into each of ``n`` sequences that have so much free."""
        self.segments.append((size, self.given[size], n, first, each, self.capacity - free))
        self.given[size] += n * each
        self.left[size] -= n * each

    def _configure(self, sizes: list[int], groups: int) -> None:
        total = sum(self.left[s] for s in sizes)
        members: list[list[int]] = []
        filled, step = 0, max(1, -(-total // groups))
        for s in sizes:  # decreasing, so the first of a group is what the others are rounded up to
            if not members or filled >= len(members) * step:
                members.append([])
            members[-1].append(s)
            filled += self.left[s]
        demand = np.array([sum(self.left[s] for s in m) for m in members], float)
        for pattern, times in configurations(np.array([m[0] for m in members]), demand, self.capacity):
            first = self._open(times)
            runs = [(first, times, self.capacity)]
            for g, each in enumerate(pattern):
                for _ in range(each):
                    runs = self._substitute(members[g], runs)
            for at, n, free in runs:
                if free:
                    insort(self.free, (free, at, n))

    def _substitute(self, members: list[int], runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """One place of this group in every sequence of the runs, filled with its longest documents left."""
        out = []
        for at, n, free in runs:
            while n:
                size = next((s for s in members if self.left[s]), None)
                if size is None:
                    out.append((at, n, free))
                    break
                now = min(n, self.left[size])
                self._place(size, now, at, 1, free)
                out.append((at, now, free - size))
                at, n = at + now, n - now
        return out

    def _best_fit(self, size: int) -> None:
        from bisect import bisect_left

        while (count := self.left[size]) > 0:
            i = bisect_left(self.free, (size, -1, -1))
            if i < len(self.free):
                free, at, n = self.free.pop(i)
            else:
                each = self.capacity // size
                n = -(-count // each)
                free, at = self.capacity, self._open(n)
            each = free // size  # the fullest stays the fullest until none fits
            whole = min(n, count // each)
            if whole:
                self._place(size, whole, at, each, free)
                if free - each * size:
                    insort(self.free, (free - each * size, at, whole))
                at, n = at + whole, n - whole
            if n and (part := self.left[size]) and part < each:
                self._place(size, 1, at, part, free)
                insort(self.free, (free - part * size, at, 1))
                at, n = at + 1, n - 1
            if n:
                insort(self.free, (free, at, n))

    def arrays(self) -> np.ndarray:
        """Segments by length and first rank."""
        found = np.array(self.segments, np.int64).reshape(-1, 6)
        return found[np.lexsort((found[:, 1], found[:, 0]))]


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[list[int], int]]:
    """Patterns (how many of each size) and how often to use each, from the linear program's optimum rounded down.

    A revised simplex over the few sizes; new patterns are priced by an exact knapsack.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(k))
        value, pattern = knapsack(sizes, dual, capacity)
        if value <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, pattern)
        level = np.linalg.solve(basis, demand)
        ratio = np.where(direction > 1e-9, level / np.maximum(direction, 1e-9), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    level = np.floor(np.linalg.solve(basis, demand) + 1e-6).astype(np.int64)
    return [(basis[:, j].round().astype(int).tolist(), int(level[j])) for j in range(k) if level[j] > 0]


def knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits."""
    useful = np.flatnonzero(value > 1e-12)
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(int(capacity // sizes.min())):
        more, item = best.copy(), np.full(capacity + 1, -1)
        for j in useful:
            s = int(sizes[j])
            candidate = best[: capacity + 1 - s] + value[j]
            better = candidate > more[s:] + 1e-12
            more[s:][better] = candidate[better]
            item[s:][better] = j
        if not (item >= 0).any():
            break
        best = more
        chosen.append(item)
    pattern, room = np.zeros(len(sizes)), capacity
    for item in reversed(chosen):
        if (j := item[room]) >= 0:
            pattern[j] += 1
            room -= int(sizes[j])
    return float(pattern @ value), pattern


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of every document.

    Null texts count as empty and give a piece of the separator alone; repeated rows are packed again, null ids pass through,
    and an empty table gives an empty result. Pieces are checkpointed, as plan and placement must see the same ranks.
    """
    pieces = checkpointed(pieces_of(docs, path, id_col, text_col, capacity, separator))
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {int(r["length"]): int(r["n"]) for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    plan = docs.sparkSession.sparkContext.broadcast(Plan(counts, capacity).arrays())
    kind = docs.schema[id_col].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length0, rank0, _, first, each, offset = plan.value.T
        key = length0 * (1 << 50) + rank0
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(key, length * (1 << 50) + rank, "right") - 1
            inside = rank - rank0[at]
            sequence, place = first[at] + inside // each[at], offset[at] + inside % each[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(base, ["task", "length"]).select(id_col, "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank_in_task")).alias("rank"))
    return ranked.mapInArrow(placed, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

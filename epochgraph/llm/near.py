"""Near-duplicates by content: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked, groups are
connected components.

Candidates are groups of SimHash fingerprints that BK-trees link within their radius (``simhash.near_links``). No such radius holds all
pairs at similarity 0.8, so the bands of a MinHash are further groups: of 32 bands of four minima such a pair has one in common but for
a chance of 5e-8 (less above). Equal sets are merged first, so that copies are one node. Only groups of two or more nodes are given the
shingles, and of groups with the same nodes one; there each node is compared exactly with the members of every group that it isn't yet
in. A group of more than ``HOT_KEY`` sets is cut into blocks, and each task is given two of them, so no task gets a whole group, however
many near copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import blocks, checkpointed, is_space, text_buffers
from .components import components, first_of_groups
from .wordtable import WordTable

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
_RNG = np.random.default_rng(11)
_FACTOR, _SHIFT = _RNG.integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32) | np.uint32(1)
_MIX = _RNG.integers(0, 1 << 63, ROWS, np.uint64) | np.uint64(1)
#: What a shingle's words are multiplied by.
_PLACE = _RNG.integers(0, 1 << 63, WIDTH, np.uint64) | np.uint64(1)
#: Shingles that one vectorised step sketches.
STEP = 2048
ROWS_AT_ONCE = 512
#: Sets of one band that are compared in one task; of more, blocks of half as many are compared two by two.
HOT_KEY = 4096
#: Rows up to which the texts to be compared are looked up by a broadcast.
FEW = 500_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _hasher() -> WordTable:
    return WordTable()


def words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, hashes of its words in order), a long row in several parts; A to Z are lowered and null texts count as empty."""
    data, offsets = text_buffers(column)
    for begin, end, rows, starts in blocks(data, offsets):
        text = _LOWER[data[begin:end]]
        starts = starts - begin
        stops = np.append(starts[1:], len(text))
        space = is_space(text)
        edge = np.zeros(len(text) + 1, bool)
        edge[starts] = True
        first = np.flatnonzero(~space & (np.append(True, space[:-1])[: len(text)] | edge[:-1]))
        last = np.flatnonzero(~space & (np.append(space, True)[1:] | edge[1:])) + 1
        hashed = _hasher().hashes(text, first, last, 1)[0]
        for r, a, b in zip(rows.tolist(), np.searchsorted(first, starts).tolist(), np.searchsorted(first, stops).tolist(), strict=True):
            yield r, hashed[a:b]


def shingles(hashed: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text's words; fewer words make one, none the empty set."""
    n = max(1, len(hashed) - WIDTH + 1) if len(hashed) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(hashed))):
        out += hashed[k : k + n] * _PLACE[k]
    out ^= out >> np.uint64(31)
    out *= _MIX[0]
    return np.unique(out ^ out >> np.uint64(29))


def bands(items: np.ndarray) -> np.ndarray:
    """One number for each band: equal if all its minima are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    narrow = (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(narrow), STEP):
        np.minimum(least, (narrow[k : k + STEP] * _FACTOR + _SHIFT).min(1), out=least)
    mixed = (least.reshape(BANDS, ROWS).astype(np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] + np.uint64(1)) * _MIX
    mixed = (mixed ^ mixed >> np.uint64(29)).sum(1, dtype=np.uint64) * _MIX[0]
    return mixed ^ mixed >> np.uint64(32)


def fingerprint(items: np.ndarray) -> int:
    """The SimHash of a set of shingles' hashes."""
    votes = np.zeros(64, np.int64)
    for k in range(0, len(items), STEP):
        votes += np.unpackbits(items[k : k + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return simhash.fingerprint(votes, len(items))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, as each row's shingles take more room than its text."""
    for batch in batches:
        for k in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.slice(k, ROWS_AT_ONCE)


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return both >= least * (len(a) + len(b) - both)


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text's shingles."""
    row, parts = 0, []
    for r, part in words(column):
        while row < r:  # what comes before is whole
            yield shingles(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
            row, parts = row + 1, []
        parts.append(part)
    while row < len(column):
        yield shingles(np.concatenate(parts) if parts else np.zeros(0, np.uint64))
        row, parts = row + 1, []


def _node(items: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(items.tobytes(), 7)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, node, fp, bands): node is a hash of the whole set; a set without shingles has no bands and no fingerprint."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, prints, keys = [], [], []
            for items in _sets(batch.column(1)):
                nodes.append(_node(items))
                prints.append(fingerprint(items))
                keys.append(bands(items).view(np.int64) if len(items) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(np.array(prints, np.uint64).view(np.int64), mask=np.array([not len(k) for k in keys], bool)), pa.array(keys, pa.list_(pa.int64()))], names=[id_col, "text_hash", "node", "fp", "bands"])

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(made, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, text_hash long, node long, fp long, bands array<long>")


def contents(docs: DataFrame, text_col: str) -> DataFrame:
    """(node, items): the distinct sets, the shingles' hashes as bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = list(_sets(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"])

    return docs.select(text_col).mapInArrow(made, "node long, items binary").dropDuplicates(["node"])


def linked(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all similar ones of these sets: each is compared with the first of every group, then with its others."""
    groups: list[list[int]] = []
    found = []
    for i, own in enumerate(sets):
        mine, rest = [i], []
        for group in groups:
            hit = next((k for k in group if similar(own, sets[k])), None)
            if hit is None:
                rest.append(group)
            else:
                found.append((nodes[i], nodes[hit]))
                mine = group + mine if mine == [i] else mine + group
        groups = [*rest, mine]
    return found


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, node, items) sorted by key to batches of links (a, b)."""
    last, nodes, sets = None, [], []

    def links() -> Iterator[pa.RecordBatch]:
        if pairs := linked(nodes, sets):
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

    for batch in slices(batches):
        for key, node, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                yield from links()
                last, nodes, sets = key, [], []
            nodes.append(node)
            sets.append(np.frombuffer(items, np.uint64))
    yield from links()


def tiled(routed: DataFrame, hot_key: int) -> DataFrame:
    """(key, node) of (key, node, n), n the key's nodes: a key with more than ``hot_key`` becomes one for each two of its blocks."""
    n = F.when(F.col("n") <= hot_key, 1).otherwise(F.ceil(2 * F.col("n") / hot_key)).cast("long")
    cut = routed.select("key", "node", n.alias("of"), F.pmod(F.xxhash64("node", F.lit(3)), n).alias("own"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("of") - 1), lambda x: (F.col("of") == 1) | (x != F.col("own")))
    cut = cut.select("key", "node", "of", "own", F.explode(others).alias("other"))
    tile = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return cut.select(F.when(F.col("of") == 1, F.col("key")).otherwise(tile).alias("key"), "node")


def alike(nodes: DataFrame) -> DataFrame:
    """(key, node) of (node, fp): nodes whose fingerprints BK-trees link, by any number of links, have one key; without fp none."""
    nodes = nodes.filter("fp IS NOT NULL")
    roots = components(simhash.near_links(checkpointed(nodes.select("fp").distinct()))).withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").select(F.xxhash64(F.coalesce("root", "fp"), F.lit(WIDTH)).alias("key"), "node")


def near_links(docs: DataFrame, prints: DataFrame, first: DataFrame, id_col: str, text_col: str, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (a, b) that connect all similar ones of the distinct sets; only sets that share a fingerprint's group or a band are made again
    from their texts.

    ``first`` (node, first) has one text for each set, as (id, text_hash).
    """
    nodes = prints.groupBy("node").agg(F.first("bands").alias("bands"))
    near = alike(prints.groupBy("node").agg(F.min("fp").alias("fp")))
    routed = nodes.select(F.explode("bands").alias("key"), "node").unionByName(near)
    hashes = (F.sum(F.shiftright(F.xxhash64("node", F.lit(k)), 20)).alias(f"h{k}") for k in range(2))  # of the nodes as a set
    shared = routed.groupBy("key").agg(F.count("*").alias("n"), *hashes).filter("n > 1").groupBy("n", "h0", "h1").agg(F.min("key").alias("key"))
    shared = checkpointed(shared.select("key", "n"))
    routed = checkpointed(routed.join(F.broadcast(shared) if shared.count() <= FEW else shared, "key"))
    of = first.join(routed.select("node").distinct(), "node", "left_semi")
    of = checkpointed(of.select(F.col(f"first.{id_col}").alias("_id"), F.col("first.text_hash").alias("_hash")).distinct())
    of = F.broadcast(of) if of.count() <= FEW else of
    items = contents(docs.join(of, (docs[id_col] == of["_id"]) & (F.xxhash64(docs[text_col]) == of["_hash"]), "left_semi"), text_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = tiled(routed, hot_key).join(items, "node").select("key", "node", "items")
    return given.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_key: int = HOT_KEY) -> DataFrame:
    """The documents, less all but one of each group: the one with the smallest id, and of equal ids with the smallest text hash.

    Of rows repeated as a whole one stays. Rows without an id can't stand for a group and all stay. Texts without words are one group.
    Copies are reduced to one row before anything is joined by their set, so a set that most documents share is no hot key. Null
    texts count as empty, texts of any length are read whole, all columns are kept, an empty table gives no rows.
    """
    prints = checkpointed(sketches(docs.filter(F.col(id_col).isNotNull()), id_col, text_col))
    first = checkpointed(prints.groupBy("node").agg(F.min(F.struct(id_col, "text_hash")).alias("first")))
    roots = components(near_links(docs, prints, first, id_col, text_col, hot_key))
    first = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    return first_of_groups(docs, prints.select(id_col, "text_hash"), first, id_col, text_col)

"""Near-duplicates by SimHash: texts whose 64-bit fingerprints differ in few bits are linked, groups are connected components.

Fingerprints within two bits agree on at least two of four 16-bit blocks. Every distinct fingerprint is routed to its six pairs
of blocks; the fingerprints of one key form a BK-tree, and the trees of one partition a shard that its own members search. In a
BK-tree a child hangs below its parent by their integer Hamming distance, so a search at distance d from a node need follow only
the edges d - 2 to d + 2. Trees travel to their searchers by the shuffle, not through the driver: fingerprints are as many
as documents. Copies of a fingerprint are merged before routing. A key with very many fingerprints is routed again by pairs of
four 8-bit blocks of its other 32 bits; 16 bits remain then, so no tree ever has more than 65,536 nodes. Inside a task links are
reduced to a spanning star, so the edges that leave it are no more than the fingerprints that came in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, checkpointed, text_buffers
from .components import components, first_of_groups

RADIUS = 2
#: Fingerprints of one key beyond which it is routed again.
HOT_KEY = 4096
#: Rows that one vectorised step searches with.
SEARCHERS = 4096


def fingerprint(votes: np.ndarray, n: int) -> int:
    """Bit i is set if more than half of the n shingles have it."""
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]) if n else 0


def add_votes(votes: np.ndarray, words: list[bytes], width: int) -> int:
    """Count the bits of the XXH64 hashes of all shingles of these words; returns how many there are."""
    from xxhash import xxh64_intdigest

    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), "<u8")
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return len(hashes)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long, text_hash long): the fingerprint of each whole text, lower-cased A to Z, over shingles of ``width`` words.

    Fewer words make one shingle, none the fingerprint zero; null texts count as empty.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out = np.zeros(len(offsets) - 1, np.uint64)
            row, n, carried, votes = -1, 0, [], np.zeros(64, np.int64)

            def finish() -> None:
                total = n
                if not n and carried:
                    total = add_votes(votes, [b" ".join(carried)], 1)
                if row >= 0:
                    out[row] = fingerprint(votes, total)

            for begin, end, rows, starts in blocks(data, offsets):
                stops = np.append(starts[1:], end)
                for r, a, b in zip(rows.tolist(), starts.tolist(), stops.tolist(), strict=True):
                    if r != row:
                        finish()
                        row, n, carried = r, 0, []
                        votes[:] = 0
                    words = carried + data[a:b].tobytes().lower().split()
                    n += add_votes(votes, words, width)
                    carried = words[-(width - 1) :] if width > 1 else []
            finish()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64)), batch.column(2)], names=[id_col, "fp", "text_hash"])

    return docs.select(id_col, text_col, F.xxhash64(text_col)).mapInArrow(made, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp long, text_hash long")


class Forest:
    """BK-trees of the distinct fingerprints of many keys, built level by level: of a parent's items at one distance the first becomes its child."""

    def __init__(self, items: np.ndarray, first_of_key: np.ndarray, members: np.ndarray):
        """first_of_key: position of each key's first item; members: how many items each key has."""
        self.items = items
        self.root = np.repeat(first_of_key, members)
        todo = np.flatnonzero(np.arange(len(items)) != self.root)
        parent, keys, children = self.root[todo], [], []
        while len(todo):
            key = parent * 65 + np.bitwise_count(items[todo] ^ items[parent])
            key, at, back = np.unique(key, return_index=True, return_inverse=True)
            keys.append(key)
            children.append(todo[at])
            rest = np.ones(len(todo), bool)
            rest[at] = False
            todo, parent = todo[rest], todo[at][back[rest]]
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.keys, self.children = keys[order], (np.concatenate(children)[order] if children else keys)

    def within(self, who: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (item, other item of its key) at most ``radius`` bits apart, in steps; ``who`` are positions of items."""
        node = self.root[who]
        while len(who):
            distance = np.bitwise_count(self.items[who] ^ self.items[node]).astype(np.int64)
            near = (distance <= radius) & (who != node)
            yield who[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(distance - radius, 0), "left")
            high = np.searchsorted(self.keys, node * 65 + np.minimum(distance + radius, 64), "right")
            n = high - low
            total = np.cumsum(n)
            at = np.arange(total[-1] if len(total) else 0) + np.repeat(low - (total - n), n)
            who, node = np.repeat(who, n), self.children[at]


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of each a with that of its b; label points to the smallest member known."""
    while len(a):
        left, right = label[a], label[b]
        apart = left != right
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def links(keys: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (item, its set's first item) among the items of equal keys; keys are sorted and items distinct within one."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    members = np.diff(np.append(first, len(keys)))
    keep = np.repeat(members > 1, members)
    items, members = items[keep], members[members > 1]
    forest = Forest(items, np.cumsum(members) - members, members)
    label = np.arange(len(items))
    for k in range(0, len(items), SEARCHERS):
        for a, b in forest.within(np.arange(k, min(k + SEARCHERS, len(items))), radius):
            unite(label, a, b)
    linked = np.flatnonzero(label != np.arange(len(items)))
    return items[linked], items[label[linked]]


def search(radius: int):
    """Batches of (key parts..., fp) sorted by key to batches of links (a, b); a key's rows are worked on together, many keys at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_items = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held_keys = np.concatenate([held_keys, np.stack([columns[0].astype(np.int64), columns[1]], 1)])
            held_items = np.concatenate([held_items, columns[2].view(np.uint64)])
            changed = np.flatnonzero((held_keys[1:] != held_keys[:-1]).any(1))
            if len(changed) and len(held_items) > 20_000:
                cut = int(changed[-1]) + 1
                yield from _batch(held_keys[:cut], held_items[:cut], radius)
                held_keys, held_items = held_keys[cut:], held_items[cut:]
        yield from _batch(held_keys, held_items, radius)

    return run


def _batch(keys: np.ndarray, items: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    number = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])[: len(keys)]
    a, b = links(number, items, radius)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _blocks_of(value, width: int, pairs: list[tuple[int, int]], first: int):
    """Structs (part, key) of all pairs of blocks, ``width`` bits each."""
    mask = (1 << width) - 1
    piece = [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit(mask)) for i in range(4)]
    return F.array(*(F.struct(F.lit(first + k).cast("long").alias("part"), (piece[i] * (1 << width) + piece[j]).cast("long").alias("key")) for k, (i, j) in enumerate(pairs)))


def near_links(nodes: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within RADIUS bits of each other."""
    pairs = list(combinations(range(4), 2))
    routed = nodes.select("fp", F.explode(_blocks_of(F.col("fp"), 16, pairs, 0)).alias("r")).select("r.part", "r.key", "fp")
    hot = checkpointed(routed.groupBy("part", "key").count().filter(F.col("count") > hot_key).select("part", "key"))
    found = routed
    if not hot.isEmpty():
        found = routed.join(hot, ["part", "key"], "left_anti")
        again = routed.join(hot, ["part", "key"], "left_semi")
        rest = None
        for k, (i, j) in enumerate(pairs):  # the two blocks that the key doesn't hold
            low, high = (x for x in range(4) if x not in (i, j))
            value = F.shiftrightunsigned("fp", 16 * low).bitwiseAND(F.lit(65535)) + F.shiftrightunsigned("fp", 16 * high).bitwiseAND(F.lit(65535)) * 65536
            rest = F.when(F.col("part") == k, value) if rest is None else rest.when(F.col("part") == k, value)
        again = again.withColumn("rest", rest).select("part", "key", "fp", F.explode(_blocks_of(F.col("rest"), 8, pairs, 1)).alias("r"))
        again = again.select((F.col("part") + 6 * F.col("r.part")).alias("part"), (F.col("key") * 65536 + F.col("r.key")).alias("key"), "fp")
        found = found.unionByName(again)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(parts, "part", "key").sortWithinPartitions("part", "key").mapInArrow(search(RADIUS), "a long, b long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id, group_fp, text_hash): component_id is the smallest id whose text is reachable by links, itself included.

    Every input row comes back once, repeated rows too. Null texts count as empty and link with other empty ones; a group in
    which no row has an id gets a null component_id. group_fp is one fingerprint of the group, the same for all of it. An empty
    table gives an empty result.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, width))
    nodes = checkpointed(prints.groupBy("fp").agg(F.min(id_col).alias("rep")))
    roots = components(near_links(nodes)).withColumnRenamed("node", "fp")
    linked = checkpointed(roots.join(nodes, "fp"))
    least = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "root").select("fp", "root", F.col("component_id").alias("linked_id"))
    named = nodes.join(named, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("linked_id")).alias("component_id"), F.coalesce("root", "fp").alias("group_fp"))
    # a checkpoint, so that the last join's both sides are plain exchanges and adaptive execution can split a hot fingerprint
    return prints.join(checkpointed(named), "fp").select(id_col, "fp", "component_id", "group_fp", "text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """The documents, less all but one of each group: the one with the smallest id, and of equal ids with the smallest text hash.

    Of rows with one id and text one stays. Rows without an id can't stand for a group and all stay.
    """
    found = groups(docs, id_col, text_col, width).filter(F.col(id_col).isNotNull())
    first = found.groupBy("group_fp").agg(F.min(F.struct(id_col, "text_hash")).alias("first"))
    return first_of_groups(docs, found.select(id_col, "text_hash"), first, id_col, text_col)


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")

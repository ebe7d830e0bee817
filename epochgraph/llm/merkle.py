"""A manifest of a dataset as a tree of digests, and for each row the path that proves it.

Digests are SHA-256 in lowercase hex, and a node's is that of its children's digests put one after the other; a last node without
a neighbour is hashed alone. Rows are leaves in the order of their ids, a tree for each group; the groups' roots, in the order of
the groups' names, are the leaves of one more tree.

Groups are cut into aligned blocks of 2 ** BLOCK leaves. First each block gives its root, by one treehash stack, and the roots are
leaves of the next level of blocks, until one node is left; that takes BLOCK bits of a place for each level, so a few small levels
however many rows. Then, from the top down, a block is walked leaf by leaf: a stack for each height makes the path's next nodes in
time, 2 * BLOCK - 1 units of work for each leaf given to the stack whose lowest node is lowest, so some 3 * BLOCK nodes
are in memory and none is made from nothing again; the path from the block's root on is the same for all its leaves and is
appended. Blocks are groups of at most 2 ** BLOCK rows, so a group that holds most rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .places import placed
from .sql import CRC_TABLE, crc32_sql

#: Binary logarithm of the leaves of a block.
BLOCK = 12
#: A step of a path: where the sibling stands, before its digest; a node without sibling has an empty step.
LEFT, RIGHT, ALONE = "<", ">", ""
#: The order in which a document's fields are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Treehash:
    """Makes the node at a height and index over leaves in units of one step: take a leaf, or hash one node."""

    def __init__(self, leaves: Sequence[str], height: int, index: int):
        self.leaves, self.height = leaves, height
        self.next, self.end = index << height, min((index + 1) << height, len(leaves))
        self.stack: list[tuple[int, str]] = []

    def done(self) -> bool:
        return len(self.stack) == 1 and self.stack[0][0] == self.height

    def low(self) -> int:
        """Height of the lowest node, by which stacks are chosen; a stack that hasn't begun counts as high as its aim."""
        return self.stack[-1][0] if self.stack else self.height

    def step(self) -> None:
        stack = self.stack
        if len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            height, right = stack.pop()
            stack[-1] = (height + 1, joined(stack[-1][1], right))
        elif self.next < self.end:
            stack.append((0, self.leaves[self.next]))
            self.next += 1
        else:  # the last node of its height, without a neighbour
            height, alone = stack.pop()
            stack.append((height + 1, joined(alone)))

    def value(self) -> str:
        while not self.done():
            self.step()
        return self.stack[0][1]


def depth(leaves: int) -> int:
    """How often nodes are joined until one is left."""
    return max(leaves - 1, 0).bit_length()


def walk(leaves: Sequence[str], height: int) -> Iterator[list[str]]:
    """Each leaf's path to the block's root, in the leaves' order."""
    n = len(leaves)
    exists = [lambda index, h=h: (index << h) < n for h in range(height)]
    siblings = [Treehash(leaves, h, 1).value() if exists[h](1) else None for h in range(height)]
    ahead: list[Treehash | None] = [Treehash(leaves, h, 0) for h in range(height)]
    for stack in ahead:
        stack.value()
    busy: list[Treehash] = []
    for leaf in range(n):
        yield [ALONE if s is None else (LEFT if leaf >> h & 1 else RIGHT) + s for h, s in enumerate(siblings)]
        for h in range(height):
            if (leaf + 1) % (1 << h):
                break
            siblings[h] = ahead[h].value() if ahead[h] else None
            index = (leaf + 1 + (1 << h) ^ 1 << h) >> h
            ahead[h] = Treehash(leaves, h, index) if exists[h](index) else None
        busy = [a for a in ahead if a and not a.done()]
        for _ in range(2 * height - 1):
            if not busy:
                break
            chosen = min(busy, key=Treehash.low)
            chosen.step()
            if chosen.done():
                busy.remove(chosen)


def _roots(nodes: DataFrame, bits: int) -> DataFrame:
    """(grp, place, total, digest) of the blocks, from such rows of their nodes."""

    def root(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        total, place = block["total"][0].as_py(), block["place"][0].as_py()
        digest = Treehash(block["digest"].to_pylist(), min(bits, depth(total)), 0).value()
        return pa.table({"grp": block["grp"][:1], "place": [place >> bits], "total": [-(-total >> bits)], "digest": [digest]})

    return nodes.select("grp", "place", "total", "digest").groupBy("grp", F.shiftright("place", bits)).applyInArrow(root, "grp string, place long, total long, digest string")


def _levels(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes, their blocks' roots, these ones' blocks' roots and so on, until each group has one node."""
    levels = [nodes]
    while True:
        levels.append(checkpointed(_roots(levels[-1], bits)))
        if (levels[-1].agg(F.max("total")).first()[0] or 1) == 1:
            return levels


def _down(nodes: DataFrame, above: DataFrame, bits: int) -> DataFrame:
    """``nodes`` with ``path`` and ``tops``; ``above`` (grp, place, path, tops) has them for each block's root."""
    columns = [c for c in nodes.columns if c != "total"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name != "total") + ", path array<string>, tops array<string>"

    def walked(block: pa.Table, root: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        rest, tops = root["path"][0].as_py(), root["tops"][0].as_py()
        paths = [path + rest for path in walk(block["digest"].to_pylist(), min(bits, depth(block["total"][0].as_py())))]
        out = block.select(columns).append_column("path", pa.array(paths, pa.list_(pa.string())))
        return out.append_column("tops", pa.array([tops] * len(block), pa.list_(pa.string())))

    blocks = nodes.groupBy("grp", F.shiftright("place", bits).alias("block"))
    return blocks.cogroup(above.groupBy("grp", F.col("place").alias("block"))).applyInArrow(walked, schema)


def proofs(rows: DataFrame, group: str, key: str, leaf: str, bits: int = BLOCK) -> DataFrame:
    """``rows`` with ``subroot`` of their group, ``root`` of all, and ``path``, the steps from the leaf to the root.

    ``leaf`` is a column of digests; leaves ascend by ``key`` (null first, ties by digest) in a group (null is one, the first). A
    step is ``<`` or ``>`` and the digest of the sibling on that side, or empty where there is none. Repeated rows are leaves
    each. No rows give no rows; the columns ``grp``, ``place``, ``total``, ``digest``, ``path``, ``tops``, ``subroot`` and ``root`` of
    ``rows`` give way. What else ``rows`` has is carried along, so pass no long texts.
    """
    rows = rows.select(*(c for c in rows.columns if c in (group, key, leaf) or c not in ("grp", "place", "total", "digest", "path", "tops", "subroot", "root")))
    named = F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit(""))
    leaves = placed(rows.withColumns({"grp": named, "digest": F.col(leaf)}), ["grp"], [key, leaf])
    levels = _levels(leaves, bits)
    groups = placed(levels[-1].select(F.col("grp").alias("name"), "digest", F.lit("").alias("grp")), ["grp"], ["name"])
    upper = _levels(groups, bits)
    above = upper[-1].select("grp", "place", F.array().cast("array<string>").alias("path"), F.array("digest").alias("tops"))
    for nodes in reversed(upper[:-1]):
        above = _down(nodes, above, bits)
    above = checkpointed(above.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("place"), "path", F.concat(F.array("digest"), "tops").alias("tops")))
    for nodes in reversed(levels[1:-1]):
        above = _down(nodes, above, bits)
    found = _down(leaves, above, bits)
    own = [c for c in rows.columns if c not in ("grp", "place", "total", "digest")]
    return found.select(*own, F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"), "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root to which a leaf leads by a path."""

    def up(digest: Column, step: Column) -> Column:
        sibling = F.substring(step, 2, 64)
        both = F.when(step.startswith(LEFT), F.concat(sibling, digest)).when(step.startswith(RIGHT), F.concat(digest, sibling)).otherwise(digest)
        return F.sha2(both, 256)

    return F.aggregate(path, leaf, up)


def siblings_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda step: F.substring(step, 2, 64)), ""), 256)


def leaf_digest(*fields: Column) -> Column:
    """Of a row: each field ``-`` if null, else its length in UTF-8 bytes, a colon, and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def checked(docs: DataFrame, every: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, by language.

    Documents whose id's CRC-32 ``every`` divides are judged after a change, one more in n_chars (null stays null); the others as
    they are. Null fields have a mark of their own, a null language is a group, documents with one id stand in the order of their
    digests. Texts of any length are hashed where they are read and never moved. No documents give no rows.
    """
    docs = docs.select(*FIELDS)
    changed = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string")) % every == 0
    rows = docs.select("doc_id", "lang", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), F.when(chosen, leaf_digest(*changed)).alias("tampered"))
    found = proofs(rows, "lang", "doc_id", "leaf")
    found = found.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return found.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(n_chars: str) -> str:
    field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0}::VARCHAR END"
    return "sha256(" + " || ".join(field.format(n_chars if f == "n_chars" else f) for f in FIELDS) + ")"


#: Levels one by one; ``nodes`` of groups and of their roots are of one kind, told apart by ``tree``.
ORACLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS MATERIALIZED (
  SELECT doc_id, '=' || lang AS g, {_leaf_sql("n_chars")} AS leaf, {crc32_sql("doc_id::VARCHAR")} % 7 = 0 AS chosen, {_leaf_sql("(n_chars + 1)")} AS changed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, {_leaf_sql("n_chars")}) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
  FROM documents, crc),
low(g, level, place, n, digest) AS (
  SELECT coalesce(g, ''), 0, place, n, leaf FROM leaves
  UNION ALL
  SELECT g, level + 1, place // 2, (n + 1) // 2, sha256(digest || coalesce(after, ''))
  FROM (SELECT *, lead(digest) OVER (PARTITION BY g ORDER BY place) AS after FROM low WHERE n > 1) WHERE place % 2 = 0),
lows AS MATERIALIZED (SELECT * FROM low),
subroots AS MATERIALIZED (SELECT g, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n FROM lows WHERE n = 1),
high(level, place, n, digest) AS (
  SELECT 0, place, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 2, (n + 1) // 2, sha256(digest || coalesce(after, ''))
  FROM (SELECT *, lead(digest) OVER (ORDER BY place) AS after FROM high WHERE n > 1) WHERE place % 2 = 0),
highs AS MATERIALIZED (SELECT * FROM high),
steps AS (
  SELECT doc_id, leaf, coalesce(l.g, '') AS g, l.place, s.level AS step, (l.place >> s.level) & 1 AS bit, x.digest
  FROM leaves l JOIN (SELECT DISTINCT g, level FROM lows WHERE n > 1) s ON s.g = coalesce(l.g, '') LEFT JOIN lows x ON x.g = s.g AND x.level = s.level AND x.place = xor(l.place >> s.level, 1)
  UNION ALL
  SELECT doc_id, leaf, coalesce(l.g, ''), l.place, 100 + s.level, (r.place >> s.level) & 1, x.digest
  FROM leaves l JOIN subroots r ON r.g = coalesce(l.g, '') JOIN (SELECT DISTINCT level FROM highs WHERE n > 1) s ON true LEFT JOIN highs x ON x.level = s.level AND x.place = xor(r.place >> s.level, 1)),
paths AS (SELECT g, place, list(CASE WHEN digest IS NULL THEN ' ' WHEN bit = 1 THEN '<' || digest ELSE '>' || digest END ORDER BY step) AS path, coalesce(string_agg(digest, '' ORDER BY step), '') AS siblings FROM steps GROUP BY ALL),
found AS (
  SELECT l.doc_id, l.leaf, r.digest AS subroot, (SELECT digest FROM highs WHERE n = 1) AS root, coalesce(siblings, '') AS siblings,
    list_reduce(coalesce(path, []), lambda a, s: sha256(CASE s[1] WHEN '<' THEN s[2:] || a WHEN '>' THEN a || s[2:] ELSE a END), CASE WHEN chosen THEN changed ELSE leaf END) AS folded_root
  FROM leaves l JOIN subroots r ON r.g = coalesce(l.g, '') LEFT JOIN paths p ON p.g = coalesce(l.g, '') AND p.place = l.place)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified FROM found
"""

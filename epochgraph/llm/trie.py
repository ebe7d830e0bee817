"""Conversations as one trie of turns, and what sharing their prefixes saves.

A turn is known by 128 bits of its digest, so no text is moved. Equal sequences of turns are one weighted sequence before any trie
is built. Sequences are dealt out by their first turn, several first turns to a bucket, and each bucket's tries are built as nested
dictionaries and folded by an iterative postorder. A first turn with more turns below it than a task should hold is divided: all its
sequences share some turns (those that the least and the greatest have in common); the node after these is a branch, and its
sequences are dealt out anew by the turn that follows, again and again. Branches are then summed up from their subtries' tops by
aggregation, the last divided ones first, and the root from all of them; so no node's children are gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .sql import CRC_TABLE, crc32_sql

#: Turns in a subtrie beyond which it is divided, and about as many as a bucket gets (some 200 bytes each in a task).
TURNS_IN_TASK = 200_000
#: Ids that agree but for so many low bits are made one text at a time.
RUN_BITS = 12
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
TOPS = f"{NODES}, parent string"
EMPTY = sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<d, n>>): the digest of each turn and the code points of its text, in order.

    Turns stand in the order of ``turn``, null first, and ties in that of their digests; a null role or text is empty; rows
    without conv_id belong to no conversation. A conversation comes together in one row, at 24 bytes a turn however long its texts.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(whole, 256), 1, 32))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", F.struct(F.col("turn").alias("at"), digest.alias("d"), F.char_length(text).cast("long").alias("n")).alias("t"))
    turns = F.array_sort(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["d"].alias("d"), t["n"].alias("n"))).alias("turns"))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of the block's first conversation, if there is one, then the own ones after the first h.

    h is the CRC-32 of the id modulo ``most``.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    lead = conversations.filter(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("lead"), F.slice("turns", 1, most - 1).alias("first"))
    both = conversations.withColumn("lead", F.col("conv_id") - F.col("conv_id") % block).join(lead, "lead", "left")
    taken = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), h)
    kept = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(taken, kept).alias("turns"))


def _key(turns: Column) -> Column:
    """A digest of a sequence of turns."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.hex(t["d"])), ""), 256)


def id_digests(members: DataFrame) -> DataFrame:
    """(key, ends_sha256) from distinct (key, conv_id): the SHA-256 of each key's ids in ascending order, comma-joined.

    Ids are joined in runs by their upper bits, so a key with very many is the work of many tasks. A digest is sequential, so where a
    key has several runs one task reads them, one at a time.
    """
    run = F.shiftright("conv_id", RUN_BITS)
    texts = F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string"))
    runs = members.groupBy("key", run.alias("run")).agg(F.array_join(texts, ",").alias("ids"))
    parts = F.count("*").over(Window.partitionBy("key"))
    runs = runs.withColumn("parts", parts)
    single = runs.filter("parts = 1").select("key", F.sha2("ids", 256).alias("ends_sha256"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, sha256()
        for batch in batches:
            ended = []
            for k, ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        ended.append((key, state.hexdigest()))
                    key, state = k, sha256()
                state.update(ids.encode())
            if ended:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*ended, strict=True)], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    several = runs.filter("parts > 1").repartition("key").sortWithinPartitions("key", "run").select("key", "ids")
    return single.unionByName(several.mapInArrow(digests, "key string, ends_sha256 string"))


class Node:
    """A node of a trie being built: children by turn, and what is known of the conversations through it."""

    __slots__ = ("chars", "children", "ends", "least", "leaves", "n", "saved")

    def __init__(self, chars: int):
        self.children: dict[bytes, Node] = {}
        self.n, self.least, self.ends, self.chars, self.leaves, self.saved = 0, None, EMPTY, chars, 0, 0

    def add(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)


def subtrie(sequences: Iterator[tuple[list[dict], int, int, str]], depth: int) -> Iterator[tuple]:
    """Rows of NODES for the trie of sequences that share their first ``depth`` turns, from that depth on; the top comes last."""
    top = None
    for turns, n, least, ends in sequences:
        if top is None:
            top = Node(turns[depth - 1]["n"])
        node = top
        node.add(n, least)
        for turn in turns[depth:]:
            node = node.children.get(turn["d"]) or node.children.setdefault(turn["d"], Node(turn["n"]))
            node.add(n, least)
        node.ends = ends
    stack = [(top, None, depth, iter(top.children.values()))]
    while stack:
        node, above, at, rest = stack[-1]
        if (child := next(rest, None)) is not None:
            stack.append((child, node, at + 1, iter(child.children.values())))
            continue
        stack.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.chars
        yield node.least, at, above and above.least, node.n, len(node.children), node.leaves, node.saved, node.ends
        if above:
            above.leaves += node.leaves
            above.saved += node.saved


def _buckets(sequences: DataFrame, buckets: int) -> DataFrame:
    """Nodes of all undivided subtries; a subtrie's top has its parent's key instead of the parent's id."""

    def built(bucket: pa.Table) -> pa.Table:
        rows, group, parents = [], {}, {}
        for key, k, parent, *sequence in zip(*(bucket[c].to_pylist() for c in ("key", "k", "parent", "turns", "n", "least", "ends")), strict=True):
            group.setdefault(key, []).append(sequence)
            parents[key] = k, parent
        for key, found in group.items():
            k, parent = parents[key]
            nodes = list(subtrie(iter(found), k))
            rows += [(*node, None) for node in nodes[:-1]] + [(*nodes[-1], parent)]
        schema = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in TOPS.split(", ")])
        return pa.table([pa.array(column, f.type) for column, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    least = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sequences.groupBy(F.pmod(F.xxhash64("key"), F.lit(max(buckets, least)))).applyInArrow(built, TOPS)


def nodes_of(conversations: DataFrame, most: int = TURNS_IN_TASK) -> DataFrame:
    """NODES of the trie of (conv_id, turns): one row for each distinct sequence of first turns, the empty one included.

    conv_id is the smallest member's. Equal conversations are members each. No conversations give no nodes. First turns with more than ``most``
    turns below them are divided.
    """
    keyed = checkpointed(conversations.select("conv_id", "turns", _key(F.col("turns")).alias("key")))
    ends = id_digests(keyed)
    rows = keyed.groupBy("key", "turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).join(ends, "key")
    rows = checkpointed(rows.select("turns", "n", "least", F.col("ends_sha256").alias("ends")))
    turnless = rows.filter(F.size("turns") == 0).select(F.lit("").alias("key"), "n", "least", "ends")
    open_ = rows.filter(F.size("turns") > 0).withColumns({"k": F.lit(1), "key": _key(F.slice("turns", 1, 1)), "parent": F.lit("")})
    whole, rounds = [], []
    while True:
        groups = open_.groupBy("key").agg(F.sum(F.size("turns") - F.col("k") + 1).alias("size"), F.count("*").alias("texts"), F.min("turns").alias("a"), F.max("turns").alias("b"), F.first("k").alias("k"), F.first("parent").alias("parent"))
        groups = checkpointed(groups.filter(F.col("size") > most).filter("texts > 1"))
        large = groups.count()
        if not large:
            whole.append(open_)
            break
        differs = F.filter(F.sequence(F.lit(1), F.least(F.size("a"), F.size("b"))), lambda i: F.element_at("a", i)["d"] != F.element_at("b", i)["d"])
        shared = F.when(F.size(differs) > 0, differs[0] - 1).otherwise(F.least(F.size("a"), F.size("b")))
        branches = groups.select("key", "k", "parent", shared.alias("m"), F.slice("a", 1, shared).alias("path"))
        branches = checkpointed(branches.withColumn("branch", _key(F.col("path"))))
        whole.append(open_.join(branches.select("key"), "key", "left_anti"))
        inside = open_.drop("k", "parent").join(branches.select("key", "m", "branch"), "key")
        ending = inside.filter(F.size("turns") == F.col("m")).select(F.col("branch").alias("key"), "n", "least", "ends")
        after = inside.filter(F.size("turns") > F.col("m"))
        open_ = checkpointed(after.select("turns", "n", "least", "ends", (F.col("m") + 1).alias("k"), _key(F.slice("turns", 1, F.col("m") + 1)).alias("key"), F.col("branch").alias("parent")))
        rounds.append((branches, ending))
    sequences = whole[0].select("turns", "n", "least", "ends", "k", "key", "parent")
    for more in whole[1:]:
        sequences = sequences.unionByName(more.select(sequences.columns))
    turns = sequences.agg(F.sum(F.size("turns"))).first()[0] or 0
    found = checkpointed(_buckets(sequences, turns // most + 1))
    tops = found.filter("parent IS NOT NULL")
    out, keys = [found.filter("parent IS NULL")], []
    for branches, ending in reversed(rounds):
        below = checkpointed(_summed(tops, ending).join(branches, F.col("at") == F.col("branch")).withColumn("saved_tokens", F.col("saved") + (F.col("n_convs") - 1) * F.element_at("path", F.col("m"))["n"]))
        keys.append(below.select(F.col("branch").alias("key"), "conv_id"))
        # the branch, and above it the nodes that all its sequences share
        chars = F.aggregate(F.slice("path", F.col("depth").cast("int"), F.col("m") - F.col("depth").cast("int")), F.lit(0).cast("long"), lambda a, t: a + t["n"])
        chain = below.withColumn("depth", F.explode(F.sequence(F.col("k").cast("long"), F.col("m").cast("long")))).withColumn("here", F.col("depth") == F.col("m"))
        chain = chain.select("conv_id", "depth", F.when(F.col("depth") > F.col("k"), F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(F.col("here"), F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
                             (F.col("saved_tokens") + (F.col("n_convs") - 1) * chars).alias("saved_tokens"), F.when(F.col("here"), F.col("ends_sha256")).otherwise(EMPTY).alias("ends_sha256"), F.when(F.col("depth") == F.col("k"), F.col("parent")).alias("parent"))
        out.append(chain.filter("parent IS NULL"))
        tops = tops.unionByName(chain.filter("parent IS NOT NULL"))
    root = checkpointed(_summed(tops.filter("parent = ''"), turnless))
    keys.append(root.select(F.col("at").alias("key"), "conv_id"))
    named = keys[0]
    for more in keys[1:]:
        named = named.unionByName(more)
    tops = tops.drop("parent_conv_id").join(named.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    out.append(root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256"))
    columns = out[-1].columns
    nodes = tops.select(columns)
    for more in out:
        nodes = nodes.unionByName(more.select(columns))
    return nodes


def _summed(tops: DataFrame, ending: DataFrame) -> DataFrame:
    """What the children of branches, and the conversations that end there, add up to."""
    children = tops.select(F.col("parent").alias("at"), "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", F.col("saved_tokens").alias("saved"), F.lit(None).cast("string").alias("ends"))
    zero = F.lit(0).cast("long")
    own = ending.select(F.col("key").alias("at"), F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), "ends")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    return children.unionByName(own).groupBy("at").agg(F.min("conv_id").alias("conv_id"), *sums, F.coalesce(F.max("ends"), F.lit(EMPTY)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations (see ``turns_of``, ``rebuilt`` and ``nodes_of``).

    Other columns are left alone. No rows give no rows.
    """
    return nodes_of(rebuilt(turns_of(conversations)))


ORACLE_SQL = f"""
WITH {CRC_TABLE},
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
asked AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS lead, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc),
parts AS (
  SELECT a.conv_id, 0 AS part, place, role, text FROM asked a JOIN own o ON o.conv_id = a.lead AND place < h
  UNION ALL SELECT a.conv_id, 1, place, role, text FROM asked a JOIN own o ON o.conv_id = a.conv_id AND place >= h),
turns AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, length(text) AS chars, sha256(strlen(role) || ':' || role || text) AS d FROM parts),
sequences AS MATERIALIZED (SELECT conv_id, list(d ORDER BY depth) FILTER (depth IS NOT NULL) AS ds FROM asked LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
prefixes AS MATERIALIZED (
  SELECT conv_id, d AS depth, coalesce(len(ds), 0) AS len, sha256(array_to_string(ds[:d], '')) AS key FROM sequences, unnest(range(coalesce(len(ds), 0) + 1)) r(d)),
nodes AS MATERIALIZED (
  SELECT depth, CASE WHEN depth > 0 THEN key ELSE '' END AS key, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL),
ancestors AS MATERIALIZED (
  SELECT n.depth, n.key, n.n_convs, coalesce(t.chars, 0) AS chars, p.depth AS up_depth, CASE WHEN p.depth > 0 THEN p.key ELSE '' END AS up_key
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN turns t ON t.conv_id = n.conv_id AND t.depth = n.depth),
parents AS (SELECT up_depth AS depth, up_key AS key, count(*) AS n_children FROM ancestors WHERE up_depth = depth - 1 GROUP BY ALL),
sums AS (
  SELECT up_depth AS depth, up_key AS key, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
  FROM ancestors a LEFT JOIN parents p ON p.depth = a.depth AND p.key = a.key GROUP BY ALL)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (depth, key) LEFT JOIN parents p ON p.depth = n.depth AND p.key = n.key
LEFT JOIN ancestors a ON a.depth = n.depth AND a.key = n.key AND a.up_depth = n.depth - 1 LEFT JOIN nodes u ON u.depth = a.up_depth AND u.key = a.up_key
"""

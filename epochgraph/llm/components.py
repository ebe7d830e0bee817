"""Connected components by alternating large-star and small-star rounds: no node's neighbours are ever gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

#: Rows up to which what goes is broadcast to the documents (some 40 bytes a row); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), longs; root is the smallest node of the component.

    Each round costs four shuffles of the edges, whose number never grows; the rounds are about the logarithm of the diameter.
    A node with very many edges is a skewed key of a join that adaptive execution can split, and minima combine before shuffling.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Edges are sets, so equal counts and equal sums of two hashes mean that a round changed nothing."""
    hashed = (F.sum(F.shiftright(F.xxhash64(*cols), 20)) for cols in (("u", "v"), ("v", "u", F.lit(1))))
    return tuple(edges.agg(F.count("*"), *hashed).first())


def first_of_groups(docs: DataFrame, hashed: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that come first in their group, by id and then by the text's hash.

    ``hashed`` (id, text_hash) has a row for each row of ``docs`` that has an id; text_hash is ``xxhash64`` of the text. ``first`` has
    for each group the struct (id, text_hash) that stays. Of rows with one id and text one stays, the one whose row hashes to the
    least. Rows without an id all stay. What goes is told by id and hash alone, so while it can be broadcast no text is shuffled but
    those of repeated rows.
    """
    keep = first.select(F.col(f"first.{id_col}").alias("_id"), F.col("first.text_hash").alias("_hash"), F.lit(True).alias("_kept"))
    rows = hashed.groupBy(F.col(id_col).alias("_id"), F.col("text_hash").alias("_hash")).agg(F.count("*").alias("_n"))
    moved = checkpointed(rows.join(keep, ["_id", "_hash"], "left").filter("_kept IS NULL OR _n > 1"))
    if moved.count() <= BROADCAST_ROWS:
        moved = F.broadcast(moved)
    own, text = docs[id_col], F.xxhash64(docs[text_col])
    rest = docs.join(moved, (own == moved["_id"]) & (text == moved["_hash"]), "left_anti")
    again = moved.filter("_kept")
    again = docs.join(again, (own == again["_id"]) & (text == again["_hash"]), "left_semi")
    hashable = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    place = F.row_number().over(Window.partitionBy(own, text).orderBy(F.xxhash64(*hashable)))
    name = "_place" + "_" * max(map(len, docs.columns))  # no column's name
    once = again.withColumn(name, place).filter(F.col(name) == 1).drop(name)
    return rest.unionByName(once)

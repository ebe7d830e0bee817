"""Near-duplicate vectors within a label by int8 tile products with rigorous error bounds.

Vectors are scaled to unit length and quantised to int8. For x = s q + e with known |e|, the inner product of two vectors lies
within |e_x| + |e_y| + |e_x| |e_y| of the quantised product, so a tile of integer products settles almost all pairs: those whose least
cosine reaches the threshold link, those whose greatest one doesn't are apart. Only the others are computed in double
precision. Integer products run in single-precision matrix routines, where they are exact.

Equal vectors of a label are merged first. The classes of a label are cut into blocks and every pair of blocks is a tile, so no
task holds more than two blocks, however large a label is. Tiles are given codes, one byte a component, and name the vectors that
have an open pair; these alone travel to the tile again, with their components, and the same bounds name the same pairs there. A tile
gives each class its number of links there and a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed
from .components import components
from .simhash import unite

THRESHOLD = 0.93
#: Classes in a block. A tile needs block^2 products at a time, 16 MB in single precision.
BLOCK = 2048
LEVELS = 127
CODES = ["codes", "scale", "lost"]
TILE = ["label", "size", "low", "high"]
#: Pairs computed in double precision at a time.
PAIRS = 1 << 16
#: Added to the bounds for rounding in double precision; far above it, far below any gap that matters.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True)  # so that neither tiny nor huge numbers leave the range when squared
    vectors = vectors / scale
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the exact length of what each vector loses by them."""
    scale = np.abs(units).max(1) / LEVELS
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    return codes, scale, np.sqrt(((units - codes * scale[:, None]) ** 2).sum(1))


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` with codes, scale and lost length instead of their vector: a byte a component instead of eight."""
    kept = [c for c in rows.columns if c != "vector"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.append(0, lists.value_lengths().to_numpy(zero_copy_only=False)))
            codes, scale, lost = np.empty(len(flat), np.int8), np.empty(len(lists)), np.empty(len(lists))
            sizes = np.diff(ends)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                at = ends[rows][:, None] + np.arange(size)
                codes[at], scale[rows], lost[rows] = quantised(unit(flat[at]))
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), data.cast(pa.binary()), pa.array(scale), pa.array(lost)], names=[*kept, *CODES])

    schema = rows.select(*kept).schema.add("codes", "binary").add("scale", "double").add("lost", "double")
    return rows.mapInArrow(run, schema)


def settled(a: tuple, b: tuple, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of two sets of (codes, scales, lost lengths): whether they surely link, and whether only components can tell.

    With x = x' + e_x: |x.y - x'.y'| <= |e_x| |y'| + |e_y|, and |y'| <= 1 + |e_y|. Each step gives the same number for (x, y) as for (y, x), in whatever
    company, so that a pair is settled alike wherever it is met.
    """
    (codes_a, scale_a, lost_a), (codes_b, scale_b, lost_b) = a, b
    kind = np.float32 if codes_a.shape[1] * LEVELS**2 < 1 << 24 else np.float64  # products are exact in it
    about = (codes_a.astype(kind) @ codes_b.astype(kind).T).astype(np.float64)
    about *= scale_a[:, None] * scale_b[None, :]
    bound = lost_a[:, None] * lost_b[None, :]
    bound += lost_a[:, None] + lost_b[None, :]
    sure = about - bound >= threshold + SLACK
    return sure, (about + bound >= threshold - SLACK) & ~sure


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (unit(a) * unit(b)).sum(1)


def usable(vector):
    """Not null, no null, NaN or infinite component, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _tiles(classes: DataFrame, block: int) -> DataFrame:
    """Every class in every tile (label, low block, high block) that it takes part in; block numbers come from hashes."""
    sizes = classes.groupBy("label", "size").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    placed = classes.join(sizes, ["label", "size"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return other.select("label", "size", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("second"), "class", "copies", *CODES)


#: What a tile gives: (class, null, rows linked with it there), (class, class, 0) for a spanning link, or an open class and its tile.
LINKS = "a long, b long, n long, low long, high long, second boolean"


def near_pairs(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Links join different rows of one label with cosine >= threshold; equal vectors always link. Rows with a null label or an
    unusable vector (null, zero, with null or non-finite components) link with nothing, nor do vectors of different length.
    Repeated rows are rows of their own. component_id is the smallest id reachable; null if no row of the component has an id. Other
    columns are not looked at, an empty table gives no rows. A block is 2,048 vectors whatever their length, which sets a task's memory.
    """
    rows = embeddings.select(F.col(id_col).alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("vector"), F.col(label_col).alias("label"))
    rows = checkpointed(rows.withColumn("valid", usable(F.col("vector")) & F.col("label").isNotNull()))
    # equal vectors have equal digests; the digest stands for the vector wherever only identity matters
    digest = F.md5(F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string"))))
    named = rows.withColumn("class", F.when(F.col("valid"), F.concat_ws("|", F.col("label").cast("string"), digest)))
    classes = named.filter("valid").groupBy("class").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = checkpointed(classes.withColumn("size", F.size("vector")).withColumn("number", F.monotonically_increasing_id()))
    codes = checkpointed(coded(classes.select(F.col("number").alias("class"), "label", "size", "copies", "vector")))
    sure = checkpointed(_tiles(codes, block).groupBy(*TILE).applyInArrow(tile(threshold), LINKS))
    # what a tile can't settle goes there again with its components: vectors, never pairs
    opened = sure.filter("low IS NOT NULL").select(F.col("a").alias("class"), "low", "high", "second")
    opened = opened.join(codes, "class").join(classes.select(F.col("number").alias("class"), "vector"), "class")
    found = sure.filter("low IS NULL").unionByName(checkpointed(opened.groupBy(*TILE).applyInArrow(tile(threshold, exactly=True), LINKS)))
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("number")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "number")
    joined = classes.select("class", "number", "copies", "least").join(counts, "number", "left").join(roots, "number", "left").withColumn("root", F.coalesce("root", "number"))
    joined = checkpointed(joined)
    smallest = joined.groupBy("root").agg(F.min("least").alias("component"))
    facts = checkpointed(joined.join(smallest, "root").select("class", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component"))
    out = named.select("id", "class").join(facts, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def tile(threshold: float, exactly: bool = False):
    """Two blocks to ``LINKS``: the pairs that codes settle, and the classes of the others; ``exactly``: those others, by components."""

    def run(table: pa.Table) -> pa.Table:
        second = table["second"].to_numpy()
        number, copies = table["class"].to_numpy(), table["copies"].to_numpy()
        scale, lost = table["scale"].to_numpy(), table["lost"].to_numpy()
        codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.int8).reshape(len(number), -1)
        vectors = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(number), -1) if exactly else None
        first, last = table["low"][0].as_py(), table["high"][0].as_py()
        low, high = np.flatnonzero(~second), np.flatnonzero(second)
        same = first == last
        if same:
            high = low
        label, n, open_ = np.arange(len(number)), np.zeros(len(number), np.int64), np.zeros(len(number), bool)
        for k in range(0, len(low), BLOCK):
            for m in range(0, len(high), BLOCK):
                if same and m < k:
                    continue
                own, other = low[k : k + BLOCK], high[m : m + BLOCK]
                sure, unsure = settled((codes[own], scale[own], lost[own]), (codes[other], scale[other], lost[other]), threshold)
                i, j = np.nonzero(unsure if exactly else sure)
                i, j = own[i], other[j]
                if same and k == m:
                    unsure &= ~np.eye(len(own), dtype=bool)  # a vector is no pair with itself
                    i, j = i[i < j], j[i < j]
                if exactly:
                    near = np.concatenate([cosine(vectors[i[p : p + PAIRS]], vectors[j[p : p + PAIRS]]) >= threshold for p in range(0, len(i), PAIRS)] or [np.zeros(0, bool)])
                    i, j = i[near], j[near]
                else:
                    open_[own] |= unsure.any(1)
                    open_[other] |= unsure.any(0)
                n += np.bincount(i, copies[j], len(n)).astype(np.int64) + np.bincount(j, copies[i], len(n)).astype(np.int64)
                unite(label, i, j)
        some, joined, again = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(label))), np.flatnonzero(open_)
        settled_rows = len(some) + len(joined)
        return pa.table({
            "a": pa.array(number[np.concatenate([some, joined, again])]),
            "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(number[label[joined]]), pa.nulls(len(again), pa.int64())]),
            "n": pa.concat_arrays([pa.array(n[some]), pa.array(np.zeros(len(joined), np.int64)), pa.nulls(len(again), pa.int64())]),
            "low": pa.concat_arrays([pa.nulls(settled_rows, pa.int64()), pa.array(np.full(len(again), first, np.int64))]),
            "high": pa.concat_arrays([pa.nulls(settled_rows, pa.int64()), pa.array(np.full(len(again), last, np.int64))]),
            "second": pa.concat_arrays([pa.nulls(settled_rows, pa.bool_()), pa.array(second[again])]),
        })

    return run

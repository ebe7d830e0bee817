"""A uniform shuffle of rows into shards of exact sizes, with one exchange.

Row counts of the shards differ by at most one, and every order of all rows is as likely as any other. Each shard is a run of bins of
exact sizes. How many rows each source partition sends to each bin is a matrix with given row and column sums: drawn so that it is
distributed as in a uniform shuffle (multivariate hypergeometric), by halving the range of partitions again and again; each draw is
seeded by its range, so that any task makes the matrix's row of its partition by log2(partitions) draws, with all tasks agreeing
on it, and the matrix is in no one place. A task permutes its rows, deals them to bins by these counts, and knows from the draws
which places in each bin are its own. After the exchange each bin is permuted again.

The driver holds a count for each source partition. A task holds 8 bytes for each row of one partition and one bin and for each bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Rows of a bin, at most; a shard has as many bins as it needs.
BIN_ROWS = 1 << 18
#: From so many rows on the library's draw isn't defined.
LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls are good; for large urns by ratio of uniforms, under a hat that bounds the density."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, drawn)) if good and drawn else 0
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))

    def weight(k: int) -> float:
        return -(lgamma(k + 1) + lgamma(good - k + 1) + lgamma(drawn - k + 1) + lgamma(bad - drawn + k + 1))

    top = weight(mode)
    mean = drawn * good / total + 0.5
    width = 2 * sqrt(2 / exp(1)) * sqrt((total - drawn) / (total - 1) * drawn * good / total * bad / total + 0.5) + 3 - 2 * sqrt(3 / exp(1))
    while True:
        u = 1.0 - rng.random()
        k = int(np.floor(mean + width * (rng.random() - 0.5) / u))
        if low <= k <= high and 2 * log(u) <= weight(k) - top:
            return k


def drawn(rng: np.random.Generator, columns: np.ndarray, rows: int) -> np.ndarray:
    """How many of ``rows`` rows, taken from all that fill ``columns``, belong to each column."""
    total = int(columns.sum())
    if total < LARGE:
        return rng.multivariate_hypergeometric(columns, rows, method="marginals")
    out = np.zeros_like(columns)
    for i, size in enumerate(map(int, columns)):
        total -= size
        out[i] = hypergeometric(rng, size, total, rows)
        rows -= int(out[i])
    return out


class Matrix:
    """Rows of the communication matrix, made where they are asked for."""

    def __init__(self, counts: list[int], bins: np.ndarray, seed: int):
        self.ends, self.bins, self.seed = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), bins, seed

    def row(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that the partition sends to each bin, the first of its places there)."""
        first, last, here, before = 0, len(self.ends) - 1, self.bins.copy(), np.zeros_like(self.bins)
        while last - first > 1:
            middle = (first + last) // 2
            left = drawn(np.random.default_rng([self.seed, 0, first, last]), here, int(self.ends[middle] - self.ends[first]))
            if part < middle:
                last, here = middle, left
            else:
                first, here, before = middle, here - left, before + left
        return here, before

    def dealt(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(bin, place in it) of each row of the partition."""
        sent, before = self.row(part)
        turn = np.random.default_rng([self.seed, 1, part]).permutation(int(sent.sum()))
        ends = np.cumsum(sent)
        bins = np.searchsorted(ends, turn, "right")
        return bins, before[bins] + turn - (ends - sent)[bins]


def even(n: int, parts: int) -> np.ndarray:
    """``n`` as ``parts`` numbers, the larger ones first, that differ by at most one."""
    return n // parts + (np.arange(parts) < n % parts).astype(np.int64)


def shuffled(rows: DataFrame, n_shards: int, seed: int = 20240229, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``rows`` with ``shard``, 0 to n_shards - 1, and ``slot``, gapless from 0 in the shard: a uniform shuffle.

    Any rows do, equal ones and nulls too: nothing is looked at, so equal texts go to different shards. Fewer rows than shards
    leave shards empty; no rows give no rows. ``shard`` and ``slot`` replace columns of these names. Rows are checkpointed
    once before the exchange, so that counts and draws speak of the same partitions however often tasks are run; the same partitions and
    seed give the same shuffle.
    """
    rows = rows.drop("shard", "slot")
    own = rows.columns
    at, to = (name + "_" * max(map(len, own), default=0) for name in ("_at", "_to"))  # no column's names
    rows = checkpointed(rows.withColumn(at, F.monotonically_increasing_id()))
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    found = {r["part"]: r["n"] for r in rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    counts = [found.get(p, 0) for p in range(max(found, default=0) + 1)]
    shards = even(sum(counts), n_shards)
    each = max(1, -(-int(shards[0]) // bin_rows))
    bins = np.concatenate([even(int(n), each) for n in shards])
    matrix = Matrix(counts, bins, seed)
    starts = (np.cumsum(bins) - bins) - np.repeat(np.cumsum(shards) - shards, each)

    @F.pandas_udf("struct<bin: long, place: long>")
    def deal(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        last, dealt = -1, None
        for parts, places in batches:
            parts, places = parts.to_numpy(), places.to_numpy()
            out = np.empty((len(parts), 2), np.int64)
            for p in np.unique(parts):
                if p != last:
                    last, dealt = p, matrix.dealt(int(p))
                here = np.flatnonzero(parts == p)
                out[here, 0], out[here, 1] = dealt[0][places[here]], dealt[1][places[here]]
            yield pd.DataFrame(out, columns=["bin", "place"])

    @F.pandas_udf("long")
    def again(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, order = -1, None
        for numbers, places in batches:
            numbers, places = numbers.to_numpy(), places.to_numpy()
            out = np.empty(len(numbers), np.int64)
            for b in np.unique(numbers):
                if b != last:
                    last, order = b, np.random.default_rng([seed, 2, int(b)]).permutation(int(bins[b]))
                here = np.flatnonzero(numbers == b)
                out[here] = starts[b] + order[places[here]]
            yield pd.Series(out)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(to, deal(part, place))
    dealt = dealt.withColumn(at, F.col(to)["bin"]).repartition(parts, at)
    return dealt.select(*own, (F.col(at) / each).cast("int").alias("shard"), again(F.col(at), F.col(to)["place"]).alias("slot"))


def write(sharded: DataFrame, path: str) -> None:
    """Shards as folders of Parquet files in the order of slots; a shard may be several files."""
    parts = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def placements(docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of documents, read from the shards' own rows.

    The law is ``rows``: counts differ by at most one. A size is that of the text in UTF-8 bytes (null: none) and 8; a null text's
    CRC-32 is the empty one's. Texts of any length travel once. Equal texts and null ids are rows like any other.
    """
    found = shuffled(docs.select("doc_id", "text"), n_shards)
    text = F.coalesce("text", F.lit(""))
    return found.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

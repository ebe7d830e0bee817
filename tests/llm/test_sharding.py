"""Shuffles into shards: sizes, gapless slots, whole rows, and that every order is as likely."""

import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from epochgraph.llm import sharding


def test_matrix():
    counts, bins = [5, 0, 17, 1, 40, 3], sharding.even(66, 8)
    matrix = sharding.Matrix(counts, bins, 3)
    rows = [matrix.row(p) for p in range(len(counts))]
    assert [int(sent.sum()) for sent, _ in rows] == counts
    assert (sum(sent for sent, _ in rows) == bins).all()
    assert (np.cumsum([sent for sent, _ in rows], axis=0) - [sent for sent, _ in rows] == [before for _, before in rows]).all()


def orders(counts, bins, seed):
    """The whole shuffle of small partitions, as the rows' numbers in the order of places."""
    matrix, out = sharding.Matrix(counts, bins, seed), np.full(sum(counts), -1)
    starts, row = np.cumsum(bins) - bins, 0
    for p, n in enumerate(counts):
        b, place = matrix.dealt(p)
        for i in range(n):
            order = np.random.default_rng([seed, 2, int(b[i])]).permutation(int(bins[b[i]]))
            out[starts[b[i]] + order[place[i]]] = row + i
        row += n
    return tuple(map(int, out))


def test_every_order_is_as_likely():
    seen = Counter(orders([3, 1], np.array([2, 2]), seed) for seed in range(12_000))
    assert set(seen) == set(permutations(range(4)))
    assert sum((n - 500) ** 2 / 500 for n in seen.values()) < 49.7  # chi-square with 23 degrees of freedom, 1 in 1,000


@pytest.mark.parametrize("good, bad, n", [(50, 30, 20), (900, 3, 400), (10**6, 2 * 10**6, 10**5)])
def test_large_urns(monkeypatch, good, bad, n):
    """The draw for large urns has the moments of the distribution."""
    monkeypatch.setattr(sharding, "LARGE", 0)
    rng = np.random.default_rng(1)
    found = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(4000)])
    mean = n * good / (good + bad)
    deviation = np.sqrt(mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1))
    assert abs(found.mean() - mean) < 4 * deviation / np.sqrt(4000) and abs(found.std() / deviation - 1) < 0.06
    columns = np.array([good, bad, 7])
    assert sharding.drawn(rng, columns, n).sum() == n and (sharding.drawn(rng, columns, n) <= columns).all()


def law(rows, n_shards):
    slots = {}
    for shard, slot in rows:
        slots.setdefault(shard, []).append(slot)
    sizes = [len(slots.get(s, ())) for s in range(n_shards)]
    assert set(slots) <= set(range(n_shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())


@pytest.mark.parametrize("n_shards, bin_rows", [(24, 1 << 20), (3, 2), (100, 5)])
def test_whole_rows(spark, odd_docs, n_shards, bin_rows):
    """Odd rows, of which several are equal, come out as they went in, with several bins a shard or empty shards."""
    docs = odd_docs.withColumnRenamed("fp", "shard").repartition(5)
    found = sharding.shuffled(docs, n_shards, bin_rows=bin_rows).collect()
    law([(r.shard, r.slot) for r in found], n_shards)
    want = docs.drop("shard").collect()
    assert Counter(tuple(r)[:-2] for r in found) == Counter(map(tuple, want))
    assert sharding.shuffled(docs.limit(0), n_shards).count() == 0


def test_placements(spark, documents, odd_docs):
    for docs in (documents, odd_docs):
        found = sharding.placements(docs).collect()
        law([(r.shard, r.slot) for r in found], 24)
        texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
        assert Counter((r.doc_id, r["size"], r.text_crc32, r.law, r.grown_shard) for r in found) == Counter((i, len(t) + 8, zlib.crc32(t), "rows", None) for i, t in texts)


def test_written(spark, documents, tmp_path):
    """Shards as files hold whole rows in the order of slots, and again the same rows for the same seed."""
    docs = documents.select("doc_id", "text")
    sharded = sharding.shuffled(docs, 4)
    sharding.write(sharded, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shuffled(docs, 4).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in back.collect()}
    assert again != {(r.doc_id, r.shard, r.slot) for r in sharding.shuffled(docs, 4, seed=1).collect()}

"""Near-duplicates against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from epochgraph.llm import components, simhash, vectors


def union(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def components_of(rows):
    prints = np.array([fingerprint(r["text"]) for r in rows], np.uint64)
    roots = union(len(rows), [(i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= 2).tolist()])
    least = {}
    for r, root in zip(rows, roots, strict=True):
        if r["doc_id"] is not None:
            least[root] = min(least.get(root, r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], f"{int(p):016x}", least.get(root)) for r, p, root in zip(rows, prints, roots, strict=True))


def test_groups(documents, odd_docs):
    for docs in (odd_docs, documents):
        got = simhash.groups(docs).select("doc_id", simhash.hex_digits("fp"), "component_id").collect()
        assert Counter(map(tuple, got)) == components_of(docs.collect())
    assert simhash.groups(odd_docs.limit(0)).count() == 0


def test_one_of_each(odd_docs):
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    want = {c for d, _, c in components_of(odd_docs.collect()) if d is not None}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([*want, None])


def test_one_of_each_under_shared_ids(spark):
    rows = [(5, "one text of some length here"), (5, "quite another one with other words"), (7, "quite another one with other words"), (2, "quite another one with other words"), (5, "one text of some length here"), (5, None), (6, "")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([rows[0], rows[3], rows[5]])


@pytest.mark.parametrize("hot", [4096, 8])
def test_links(spark, hot):
    rnd = random.Random(hot)
    items = set()
    for _ in range(60):
        base = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 40)):
            x = base
            for k in rnd.sample(range(64), rnd.randrange(5)):
                x ^= 1 << k
            items.add(x)
    items = sorted(items)
    signed = np.array(items, np.uint64).view(np.int64).tolist()
    edges = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), hot_key=hot).collect()
    place = {x: i for i, x in enumerate(signed)}
    got = union(len(items), [(place[r["a"]], place[r["b"]]) for r in edges])
    want = union(len(items), [(i, j) for i in range(len(items)) for j in range(i) if (items[i] ^ items[j]).bit_count() <= 2])
    assert got == want
    assert all((items[place[r["a"]]] ^ items[place[r["b"]]]).bit_count() <= 64 for r in edges)


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 200) if i % 37] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(70)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    roots = union(600, pairs)
    assert got == {x: roots[x] for p in pairs for x in p if p[0] != p[1]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, float)
        return v / np.linalg.norm(v)

    units = [unit(r["embedding"]) if r["label"] is not None else None for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if units[i] is not None and units[j] is not None and rows[i]["label"] == rows[j]["label"] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.93]
    links = Counter(x for p in pairs for x in p)
    roots, least = union(len(rows), pairs), {}
    for r, root in zip(rows, roots, strict=True):
        if r["vec_id"] is not None:
            least[root] = min(least.get(root, r["vec_id"]), r["vec_id"])
    return Counter((r["vec_id"], links[i], least.get(roots[i]), r["vec_id"] is not None and r["vec_id"] == least.get(roots[i])) for i, r in enumerate(rows))


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    data = []
    for i in range(260):
        v = (centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.05, 0.25])).astype(np.float32).tolist()
        data.append((i, v, int(rng.integers(3))))
    data += [(300 + i, data[0][1], data[0][2]) for i in range(30)] + [data[1], data[1], (400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] + [1.0] * 15, 1), (404, [float("inf")] + [1.0] * 15, 1), (405, data[0][1], None), (None, data[2][1], data[2][2]), (406, [1.0, 2.0], 0), (407, [2.0, 4.0], 0), (408, [1e-30, 2e-30], 0), (409, [1e30, 2e30], 0), (410, [], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash"))
    got = Counter(map(tuple, vectors.near_pairs(df, block=block).collect()))
    assert got == brute_vectors(df.collect())
    assert vectors.near_pairs(df.limit(0)).count() == 0


def test_bounds_lose_nothing():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(300, 24))
    b = np.concatenate([a[:150] + rng.normal(size=(150, 24)) * 0.39, rng.normal(size=(100, 24))])
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit(a) @ unit(b).T >= 0.93
    of_a, of_b = vectors.quantised(vectors.unit(a)), vectors.quantised(vectors.unit(b))
    sure, unsure = vectors.settled(of_a, of_b, 0.93)
    assert not (sure & ~near).any() and not (near & ~sure & ~unsure).any() and not (sure & unsure).any()
    assert near.sum() > 20 and sure.sum() > 5 and 0 < unsure.sum() < 50  # codes settle almost all
    back, open_back = vectors.settled(of_b, of_a, 0.93)  # a pair is settled alike either way round and in other company
    assert (back.T == sure).all() and (open_back.T == unsure).all()
    rows = rng.permutation(300)[:40]
    some, open_some = vectors.settled(tuple(x[rows] for x in of_a), of_b, 0.93)
    assert (some == sure[rows]).all() and (open_some == unsure[rows]).all()


def test_tiles_are_given_codes(spark):
    """A tile's rows carry a byte a component; components travel only for vectors with an open pair."""
    rng = np.random.default_rng(8)
    flat = [(i, v.tolist(), 1, 1) for i, v in enumerate(rng.normal(size=(50, 32)))]
    rows = spark.createDataFrame(flat, "class long, vector array<double>, label int, copies long").withColumn("size", F.size("vector"))
    tiles = vectors._tiles(vectors.coded(rows), 16)
    assert "vector" not in tiles.columns and {r[0] for r in tiles.select(F.length("codes")).collect()} == {32}
    assert tiles.groupBy("low", "high", "class").count().filter("count > 1").count() == 0


def test_long_fingerprint(spark):
    """A text of several blocks: shingles across their bounds count."""
    rnd = random.Random(9)
    text = " ".join(f"W{rnd.randrange(5000)}é" for _ in range(120_000))
    (row,) = simhash.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(simhash.hex_digits("fp").alias("fp")).collect()
    assert row["fp"] == f"{fingerprint(text):016x}"

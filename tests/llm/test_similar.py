"""The pipeline's near-duplicate stage: every pair of texts at similarity 0.8 or more is in one group, and nothing else."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
from epochgraph.llm import near, simhash
from pyspark.sql import functions as F
from support import SF


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def kept(texts):
    """Ids that stay, by comparing all pairs."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(texts)) if find(i) == i}


def test_near_copies(spark):
    rng = random.Random(3)
    texts = ["", None, " \n", "two words", "Two  Words", "one two three four five", "one two three four five six"]
    for _ in range(40):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 200))]
        texts.append(" ".join(words))
        for _ in range(6):  # changes of one word each touch five shingles; chains of copies of copies link too
            words = list(words)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = kept(texts)
    assert {r["doc_id"] for r in corpus_pipeline.thin(spark, docs, SF).collect()} == want
    assert len(want) < len(texts) // 2


def test_large_groups_are_cut(spark):
    """A group of near copies far larger than what one task compares is found whole, and no task compares more."""
    rng = random.Random(12)
    texts = []
    for size in (70, 30, 1, 2):
        words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
        for _ in range(size):
            own = list(words)
            own[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near.one_of_each(docs, hot_key=16).collect()} == kept(texts) == {0, 70, 100, 101}
    routed = spark.createDataFrame([(1, x, 70) for x in range(70)] + [(2, x, 16) for x in range(16)], "key long, node long, n long")
    tiles = {}
    for r in near.tiled(routed, 16).collect():
        tiles.setdefault(r["key"], set()).add(r["node"])
    assert tiles[2] == set(range(16)) and max(map(len, tiles.values())) < 70
    assert all(any({a, b} <= t for t in tiles.values()) for a in range(70) for b in range(a))


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (3, "A b c d e f"), (4, "other text")]
    found = corpus_pipeline.thin(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in found) == [(0, "a b c d e f"), (0, "a b c d e f"), (3, "A b c d e f"), (4, "other text")]
    assert corpus_pipeline.thin(spark, spark.createDataFrame([], "doc_id long, text string"), SF).count() == 0


def test_clashing_columns_and_equal_ids(spark):
    """Of rows with one id and text one stays whatever else differs, and no column is overwritten."""
    rows = [(1, "a b c d e f", "x", 0, {"k": 1}), (1, "a b c d e f", "y", 1, {"k": 2}), (2, "a b c d e f", "z", 2, None), (3, "other words", "h", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text_hash__ string, _hash int, _kept map<string,int>")
    for stage in (lambda d: corpus_pipeline.thin(spark, d, SF), simhash.one_of_each):
        found = [tuple(r) for r in stage(df).collect()]
        assert stage(df).columns == df.columns and len(found) == 2 and all(r in rows for r in found)
        assert sorted(r[0] for r in found) == [1, 3] and {r[:4] for r in found} == {tuple(r)[:4] for r in stage(df.repartition(3)).collect()}


def test_long_text(spark):
    """A text of several blocks, one word apart from its copy, and the same shingles as word by word."""
    rng = random.Random(8)
    words = [f"W{rng.randrange(3000)}" for _ in range(500_000)]
    long = " ".join(words)
    other = " ".join(words[:1000] + ["changed"] + words[1001:])
    docs = spark.createDataFrame([(1, other), (2, long), (3, "short")], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.thin(spark, docs, SF).collect()} == {1, 3}
    assert len(next(near._sets(pa.array([long])))) == len(shingles(long))


@pytest.mark.parametrize("hot", [4096, 4])
def test_fingerprints_alone_find_near_copies(spark, hot):
    """With all bands taken away, BK-trees of fingerprints still lead to the similar texts within their radius, and the exact check still decides."""
    rng = random.Random(4)
    texts = ["", "one two three four five six"]
    for _ in range(3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        texts += [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(["another"] + words[1:]), " ".join(words + ["more"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = near.sketches(docs, "doc_id", "text")
    fp = {r["node"]: r["fp"] for r in prints.collect()}
    assert sum(x is None for x in fp.values()) == 1  # no shingles, no fingerprint
    near_by = {(a, b) for a in fp for b in fp if a < b and None not in (fp[a], fp[b]) and ((fp[a] ^ fp[b]) % 2**64).bit_count() <= simhash.RADIUS}
    assert len(near_by) > 5
    first = prints.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    none = prints.withColumn("bands", F.array().cast("array<long>"))
    root = {x: x for x in fp}
    for r in near.near_links(docs, none, first, "doc_id", "text", hot_key=hot).collect():
        old, new = root[r["a"]], root[r["b"]]
        root = {x: new if y == old else y for x, y in root.items()}
    assert all(root[a] == root[b] for a, b in near_by)
    assert len(set(root.values())) >= 5

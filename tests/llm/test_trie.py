"""Tries of conversations against all prefixes in plain Python."""

import zlib
from hashlib import sha256

import pytest
from epochgraph.llm import trie
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, key string"


def rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: (t[:2], trie_order(t[2], t[3])))] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def trie_order(role, text):
    return sha256((f"{len(role.encode())}:{role}{text}").encode()).digest()[:16]


def wanted(conversations):
    prefixes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            prefixes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, members in prefixes.items():
        below = [q for q in prefixes if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(prefixes[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(p))
        out.append((min(members), len(p), min(prefixes[p[:-1]]) if p else None, len(members), len(children), leaves, saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns(conv, *texts):
    return [(conv, i, "user" if i % 2 == 0 else "assistant", t, "clash") for i, t in enumerate(texts)]


ROWS = [
    *turns(0, "a", "b", "c", "d", "e", "f", "g"),
    *(row for c in range(1, 30) for row in turns(c, "hot", "next" if c % 3 else "other", *(str(c % 4) for _ in range(c % 7)))),
    *turns(150, "hot"),
    *turns(151, *["long"] * 300),
    *turns(152, *["long"] * 299, "end"),
    (153, None, None, None, None),
    (153, 1, "", "", None),
    (154, 2, "user", "tie", None),
    (154, 2, "user", "Tie é", None),
    (154, 2, "user", "tie", None),
    (None, 0, "user", "lost", None),
    (200, 0, "user", "word " * 40_000, None),
    *turns(207, "hot", "next"),
]


@pytest.mark.parametrize("most", [1, 12, 40, trie.TURNS_IN_TASK])
def test_divided(spark, most):
    """The same nodes however often subtries are divided: ties, nulls, copies, very long conversations, missing leaders, turnless ones."""
    df = spark.createDataFrame(ROWS, SCHEMA)
    found = trie.nodes_of(trie.rebuilt(trie.turns_of(df)), most)
    assert sorted(map(tuple, found.collect()), key=repr) == wanted(rebuilt(ROWS))


def test_chains_and_ends(spark):
    """Oversized subtries whose sequences share several turns, of which one ends where the others branch."""
    sequences = {i: ("x", "y", "z") + s for i, s in enumerate([(), ("a",), ("b",), ("b", "c"), ("b", "c", "d"), ("b",), ("a", "a")])} | {9: (), 8: (), 7: ("q",)}
    rows = [(c, [(sha256(t.encode()).digest()[:16], len(t)) for t in s]) for c, s in sequences.items()]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<d: binary, n: long>>")
    want = wanted({c: [("", t) for t in s] for c, s in sequences.items()})
    for most in (1, 3, 6, 100):
        assert sorted(map(tuple, trie.nodes_of(df, most).collect()), key=repr) == want


def test_ids_in_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN_BITS", 2)
    df = spark.range(100).select(F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("key"), F.col("id").alias("conv_id"))
    found = {r["key"]: r.ends_sha256 for r in trie.id_digests(df).collect()}
    assert found == {k: sha256(",".join(str(i) for i in range(100) if (i % 10 == 0) == (k == "few")).encode()).hexdigest() for k in ("few", "many")}


def test_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0

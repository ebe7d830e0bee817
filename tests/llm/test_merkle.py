"""Trees of digests against levels made one by one, and paths against folding."""

import zlib
from hashlib import sha256

import pytest
from epochgraph.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def up(level):
    return [h(*level[i : i + 2]) for i in range(0, len(level), 2)]


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    return levels


def path(levels, place):
    out = []
    for level in levels[:-1]:
        other = place ^ 1
        out.append(("<" if place & 1 else ">") + level[other] if other < len(level) else "")
        place >>= 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 100])
def test_walk(n):
    leaves = [h(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert merkle.Treehash(leaves, merkle.depth(n), 0).value() == levels[-1][0]
    assert list(merkle.walk(leaves, merkle.depth(n))) == [path(levels, i) for i in range(n)]


def test_walk_is_in_time_and_small(monkeypatch):
    """Stacks are done when their node is due, and hold few nodes in all."""
    held, late = [], []
    step, value = merkle.Treehash.step, merkle.Treehash.value
    monkeypatch.setattr(merkle.Treehash, "value", lambda self: (late.append(not self.done()), value(self))[1])
    leaves = [h(str(i)) for i in range(1 << 9)]
    paths = merkle.walk(leaves, 9)
    next(paths)
    late.clear()
    for _ in paths:
        frame = paths.gi_frame.f_locals if paths.gi_frame else {}
        held.append(sum(len(a.stack) for a in frame.get("ahead", ()) if a))
    assert not any(late) and max(held) <= 3 * 9
    assert step


def wanted(rows):
    """The contract's columns for rows (doc_id, source, lang, n_chars, text), one by one."""

    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(langs[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for at, g in enumerate(order):
        for place, (_, _, digest, row) in enumerate(sorted(langs[g], key=lambda x: x[:3])):
            steps = path(trees[g], place) + path(top, at)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = leaf((*row[:3], row[3] if row[3] is None else row[3] + 1, row[4])) if tampered else digest
            for s in steps:
                folded = h(s[1:], folded) if s[:1] == "<" else h(folded, s[1:])
            out.append((row[0], digest, trees[g][-1][0], top[-1][0], h(*(s[1:] for s in steps)), folded, folded == top[-1][0]))
    return out


def same(found, want):
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_odd_documents(spark, odd_docs):
    """Nulls in every column, very long and empty texts, repeated rows, clashing columns."""
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in odd_docs.collect()]
    docs = odd_docs.withColumnsRenamed({"fp": "root", "score": "path"})
    same(merkle.checked(docs).collect(), wanted(rows))


def test_empty_and_single(spark, odd_docs):
    assert merkle.checked(odd_docs.limit(0)).count() == 0
    one = [(5, "s", None, None, None)]
    docs = spark.createDataFrame(one, "doc_id long, source string, lang string, n_chars long, text string")
    same(merkle.checked(docs).collect(), wanted(one))


def test_levels_of_blocks(spark):
    """Blocks of four leaves, so that trees and the groups' tree have several levels of blocks; one group holds most rows."""
    rows = [(i * 13 % 1009, f"{i % 3}", "big" if i % 3 else f"g{i % 90:02}", i, "t" * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest(*map(docs.__getitem__, merkle.FIELDS)).alias("leaf"))
    found = merkle.proofs(leaves, "lang", "doc_id", "leaf", bits=2).collect()
    want = {(w[0], w[1]): w for w in wanted(rows)}
    assert len(found) == 300
    for r in found:
        w = want[r.doc_id, r.leaf]
        assert (r.subroot, r.root, h(*(s[1:] for s in r.path))) == (w[2], w[3], w[4])


def test_documents(spark, documents):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in documents.collect()]
    same(merkle.checked(documents).collect(), wanted(rows))

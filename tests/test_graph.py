"""Parts of the dependency graph on random registries: resolution by ranges, paths inside releases, and the closure by contraction."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from epochgraph.functions import semver
from epochgraph.operators import graph, temporal
from epochgraph.plans import counts, prepare, query

from test_engine import brute, frames, random_registry
from test_semver import TEXTS, matches, order, text_of

T0 = datetime(2020, 1, 1)


@pytest.mark.parametrize("seed", range(2))
def test_resolved_as_all_pairs(spark, seed):
    """Any requirement at any time, prereleases, ties in time and equal numbers included, against a maximum over all releases."""
    rnd = random.Random(seed)
    releases = [(i, rnd.randrange(3), (rnd.randrange(2), rnd.randrange(3), rnd.randrange(3), rnd.choice(["", "", "", "alpha.2", "rc.1"])), rnd.randrange(12)) for i in range(120)]
    rows = spark.createDataFrame([(i, c, text_of(v), T0 + timedelta(days=t)) for i, c, v, t in releases], "version_id long, crate_id long, num string, created_at timestamp").withColumn("ver", semver.version(F.col("num")))
    texts = [*TEXTS, ">=1.0.0-alpha, <1.2", "<=0.2.1-rc.1", ">0.1, <0.1"]
    asked = spark.createDataFrame([(c, t) for c in range(4) for t in texts], "crate_id long, req_key string").withColumn("made", semver.compiled(semver.requirement(F.col("req_key")))).select("crate_id", "req_key", "made.*")
    got = {}
    for r in graph.resolved(asked, rows).collect():
        for t in range(12):
            if r["valid_from"] <= T0 + timedelta(days=t) < r["valid_to"]:
                assert (r["crate_id"], r["req_key"], t) not in got
                got[r["crate_id"], r["req_key"], t] = r["version_id"]
    want = {}
    for text in texts:
        req = semver.parse_requirement(text)
        fitting = [r for r in releases if matches(req, r[2])]
        for c, t in ((c, t) for c in range(4) for t in range(12)):
            if found := [r for r in fitting if r[1] == c and r[3] <= t]:
                want[c, text, t] = max(found, key=lambda r: (*r[2][:3], order(r[2][3]), r[0]))[0]
    assert got == want


def test_inner_paths(spark):
    """Chains, a cycle, defaults that lead on, a feature of another package, and releases that declare nothing."""
    features = [
        [("a", [(1, "b")], []), ("b", [(1, "c"), (2, "far")], []), ("c", [(1, "a")], []), ("default", [(1, "a")], []), ("lone", [], [])],
        [],
        None,
    ]
    rows = spark.createDataFrame([(i, 1, T0, f) for i, f in enumerate(features)], f"version_id long, crate_id long, created_at timestamp, features {graph_features()}")
    got = {(r["version_id"], r["feature"]): sorted(r["above"]) for r in graph.inner_paths(rows).collect()}
    cycle = ["a", "b", "c", "default"]
    assert {k: [a for a in v if a != k[1]] for k, v in got.items() if k[0] == 0} == {(0, ""): [*cycle, "lone"], **{(0, f): [a for a in cycle if a != f] for f in "abc"}}
    assert got[1, ""] == ["default"] and all(r["since"] == T0 for r in graph.inner_paths(rows).collect())


def graph_features():
    from epochgraph.sources.schema import FEATURES

    return FEATURES


@pytest.mark.parametrize("seed", [11, 12])
def test_closure_at_dates(spark, seed):
    """Dependents at some dates, with times clipped to these, against snapshots."""
    names, rel, dep = random_registry(seed)
    registry = frames(spark, names, rel, dep)
    asked = ["pkg-0", "pkg-1:^1"]
    predicates = graph.durable(query.bind(registry, asked))
    want = brute(names, rel, dep, [[(0, None)], [(1, semver.parse_requirement("^1"))]], True)
    days = [2, 5, 8]
    dates = [str(T0 + timedelta(days=d)) for d in days]
    clipped = prepare.asked_at(counts.prepared(registry, predicates, transitive=True), dates)
    found = temporal.at_dates(counts.dependents(clipped, predicates, transitive=True), dates).select("as_of", "query_id", "version_id").distinct().collect()
    for d in days:
        for q in range(2):
            assert sum(r["as_of"] == T0 + timedelta(days=d) and r["query_id"] == q for r in found) == want[d, q]


def test_closure_of_a_long_chain(spark):
    """Rounds that shuffle, merge and meet cycles: 20 releases in a chain, of which the last depends on the first again for a time."""
    from epochgraph.sources.schema import FEATURES

    n = 20
    day = lambda i: T0 + timedelta(days=i)
    releases = spark.createDataFrame([(i, i, day(i % 5), [("up", [(i, "default")], [])]) for i in range(n)], f"version_id long, crate_id long, created_at timestamp, features {FEATURES}")
    rows = [(i + 1, "", i, "default" if i % 2 else "up", day(i % 7), day(30)) for i in range(n - 1)] + [(0, "", n - 1, "up", day(3), day(12))]
    edges = spark.createDataFrame(rows, "src_v long, src_f string, dst_v long, dst_f string, valid_from timestamp, valid_to timestamp")
    start = spark.createDataFrame([(5, 0, day(0), datetime(9999, 12, 31))], "version_id long, query_id int, valid_from timestamp, valid_to timestamp")
    few = graph.FEW
    results = []
    for graph.FEW in (few, 0):
        results.append(sorted(map(tuple, temporal.coalesce_intervals(graph.reachable(start, releases, edges), ["version_id", "feature", "query_id"]).collect())))
    graph.FEW = few
    assert results[0] == results[1]
    own = {(v, f): {(v, "")} | ({(v, "default")} if f == "up" else set()) for v in range(n) for f in ("up", "default")}
    for t in range(35):
        reached, more = set(), {(5, "")} if t >= 0 else set()
        while more:
            reached |= more
            more = {(a, b) for a, b, c, d, f, u in rows if (c, d) in reached and f <= day(t) < u} | {k for k, to in own.items() if to & reached and t >= k[0] % 5}
            more -= reached
        assert {(v, f) for v, f, _, a, b in results[0] if a <= day(t) < b} == reached, t

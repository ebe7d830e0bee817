"""The whole engine on random small registries against evaluation of every snapshot in plain Python, features included."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from epochgraph.functions import semver
from epochgraph.plans import counts, query
from epochgraph.plans.prepare import clamp, exclude
from epochgraph.sources.schema import FEATURES, Registry
from epochgraph.sources.star import with_requirements


from test_semver import matches, order, text_of

T0 = datetime(2020, 1, 1)


def random_registry(seed, crates=6, releases=22, deps=40):
    rnd = random.Random(seed)
    names = [f"pkg-{i}" for i in range(crates)]
    rel, used = [], set()
    for i in range(releases):
        c = rnd.randrange(crates)
        v = (rnd.randrange(3), rnd.randrange(3), rnd.randrange(3), rnd.choice(["", "", "", "alpha.1"]))
        if (c, v) in used:
            continue
        used.add((c, v))
        features = []
        for f in rnd.sample(["default", "x", "y"], rnd.randrange(4)):
            features.append((f, [(rnd.choice([c, rnd.randrange(crates)]), rnd.choice(["x", "y", "z"])) for _ in range(rnd.randrange(3))]))
        rel.append({"id": i, "crate": c, "v": v, "t": rnd.randrange(10), "features": features})
    reqs = ["*", "^1", "^0.1", "~1.1", ">=0.1", "<2", "=1.0", "^1.0.0-alpha.1", ">0, <2", "0.*"]
    dep = []
    for i in range(deps):
        r = rnd.choice(rel)
        optional = rnd.random() < 0.3
        dep.append({"id": i, "rel": r["id"], "crate": rnd.randrange(crates), "req": rnd.choice(reqs), "feature": rnd.choice(["x", "opt"]) if optional else "", "default": rnd.random() < 0.5, "features": sorted(rnd.sample(["x", "y"], rnd.randrange(3))), "kind": rnd.choice(["normal", "normal", "build", "dev"])})
    return names, rel, dep


def frames(spark, names, rel, dep):
    packages = spark.createDataFrame(list(enumerate(names)), "crate_id long, name string")
    rows = [(r["id"], r["crate"], text_of(r["v"]), T0 + timedelta(days=r["t"]), r["id"], [(f, e, []) for f, e in r["features"]]) for r in rel]
    releases = spark.createDataFrame(rows, f"version_id long, crate_id long, num string, created_at timestamp, load_ord long, features {FEATURES}").withColumn("ver", semver.version(F.col("num")))
    deps = spark.createDataFrame([(d["id"], d["rel"], d["crate"], d["req"], d["feature"], d["default"], d["features"], d["kind"]) for d in dep], "dep_id long, version_id long, crate_id long, req_text string, feature string, default_features boolean, features array<string>, kind string")
    owners = spark.createDataFrame([("Ann", "user", 1), ("Org/Core", "team", 2), ("nobody", "user", 3)], "owner string, kind string, owner_id long")
    owned = spark.createDataFrame([("user", 1, 0), ("user", 1, 2), ("team", 2, 3)], "kind string, owner_id long, crate_id long")
    return Registry(packages, releases, with_requirements(deps), owners, owned)


def brute(names, rel, dep, predicates, transitive):
    """Counts of each query at each day, snapshot by snapshot."""
    full = lambda v: (*v[:3], order(v[3]))
    reqs = {}
    ordered = sorted(rel, key=lambda r: (r["t"], r["id"]))
    for d in dep:
        reqs[d["id"]] = semver.parse_requirement(d["req"])
        own = next((r for r in rel if r["id"] == d["rel"]), None)
        if own is None:
            continue
        out = [r for r in ordered[: ordered.index(own) + 1] if r["crate"] == d["crate"]]
        if out:
            m = max(out, key=lambda r: full(r["v"]))["v"]
            later = (m[0] + 1, 0, 0, "") if m[0] else (0, m[1] + 1, 0, "") if m[1] else (0, 0, m[2] + 1, "")
            if matches(reqs[d["id"]], later):
                reqs[d["id"]] = (semver.Comparator("caret", *m[:3]),)
    table = {}
    for t in range(11):
        live = [r for r in rel if r["t"] <= t]
        latest = {max((r for r in live if r["crate"] == c), key=lambda r: (not r["v"][3], r["t"], r["id"]))["id"] for c in {r["crate"] for r in live}}

        def resolve(crate, req):
            fit = [r for r in live if r["crate"] == crate and matches(req, r["v"])]
            return max(fit, key=lambda r: (full(r["v"]), r["id"]))["id"] if fit else None

        target = {d["id"]: resolve(d["crate"], reqs[d["id"]]) for d in dep}
        edges = set()
        for d in dep:
            if d["kind"] != "dev" and target[d["id"]] is not None:
                wanted = ([""] if not d["features"] else []) if not d["default"] else ["default"]
                edges |= {((d["rel"], d["feature"]), (target[d["id"]], f)) for f in wanted + d["features"]}
        for r in live:
            edges.add(((r["id"], "default"), (r["id"], "")))
            for f, enables in r["features"]:
                if f != "default":
                    edges.add(((r["id"], f), (r["id"], "")))
                for c, g in enables:
                    if c == r["crate"]:
                        edges.add(((r["id"], f), (r["id"], g)))
                    else:
                        edges |= {((r["id"], f), (target[d["id"]], g)) for d in dep if d["rel"] == r["id"] and d["crate"] == c and target[d["id"]] is not None}
        for q, wanted in enumerate(predicates):
            match = {r["id"] for r in live for c, req in wanted if r["crate"] == c and (req is None or matches(req, r["v"]))}
            found = {d["rel"] for d in dep if target[d["id"]] in match} & latest
            if transitive:
                reached = {(m, "") for m in match}
                while more := {a for a, b in edges if b in reached} - reached:
                    reached |= more
                found |= {v for v, _ in reached} & latest
            table[t, q] = len(found)
    return table


@pytest.mark.parametrize("seed, transitive", [(1, False), (2, False), (3, True), (4, True), (5, True)])
def test_against_snapshots(spark, seed, transitive):
    names, rel, dep = random_registry(seed)
    asked = ["pkg-0", "pkg_1:^1", "pkg-2 + pkg-3:>=0.1", "@ANN", "pkg-0 + pkg-0"]
    predicates = [[(0, None)], [(1, semver.parse_requirement("^1"))], [(2, None), (3, semver.parse_requirement(">=0.1"))], [(0, None), (2, None)], [(0, None)]]
    got = {((r["ts"] - T0).days, r["query_id"]): r["value"] for r in counts.over_time(frames(spark, names, rel, dep), asked, transitive).collect()}
    want = brute(names, rel, dep, predicates, transitive)
    last, steps = [0] * len(asked), {}
    for t in range(11):
        now = [want[t, q] for q in range(len(asked))]
        if now != last:
            steps |= {(t, q): v for q, v in enumerate(now)}
        last = now
    assert got == steps


def test_exclude_and_total(spark):
    names, rel, dep = random_registry(7)
    registry = exclude(frames(spark, names, rel, dep), ["^pkg-[01]$"])
    assert {r["crate_id"] for r in registry.releases.collect()} == {r["crate"] for r in rel if r["crate"] > 1}
    found = counts.over_time(frames(spark, names, rel, dep), ["pkg-2"], exclude_patterns=["0$"], relative=True).collect()
    for r in found:
        born = {x["crate"] for x in rel if x["crate"] and T0 + timedelta(days=x["t"]) <= r["ts"]}
        assert r["total"] == len(born) and abs(r["fraction"] - r["value"] / len(born)) < 1e-6


def test_clamp_keeps_rows(spark):
    names, rel, dep = random_registry(8)
    registry = frames(spark, names, rel, dep)
    assert clamp(registry).dependencies.count() == len(dep)


def test_queries(spark):
    names, rel, dep = random_registry(9)
    registry = frames(spark, names, rel, dep)
    assert query.labels(registry, ["pkg_0:1 + @ann", "pkg-1:*"]) == ["pkg-0:^1 or @Ann", "pkg-1:*"]
    assert query.bind(registry, ["@nobody"]).count() == 0
    assert {(r["query_id"], r["crate_id"]) for r in query.bind(registry, ["@org/core", "pkg-1"]).collect()} == {(0, 3), (1, 1)}
    for wrong in ("nothing", "@unknown", "pkg-1 :1", "PKG-1"):
        with pytest.raises(query.QueryError):
            query.bind(registry, [wrong])
    with pytest.raises(query.QueryError):
        query.bind(registry, ["pkg-1"] * 257)
    for wrong in ("@a--b", "1abc", "a:b", "@-a", "a b", ""):
        with pytest.raises(query.QueryError):
            query.check(wrong)
    for right in ("serde:1.0", "anyhow:^1.0 + thiserror", "@org/team", "serde :1"):
        assert query.check(right) == right


def test_lines(spark):
    data = [(T0 + timedelta(days=i), 0, i) for i in range(30)]
    df = spark.createDataFrame(data, "ts timestamp, query_id int, value long")
    assert len(list(counts.lines(df, 1))) == 30
    short = list(counts.lines(df, 1, head=10))
    assert len(short) == 21 and short[10] == "..." and short[0] == "2020-01-01 00:00:00 [0]" and short[-1] == "2020-01-30 00:00:00 [29]"


def test_lines_written_in_order(spark, tmp_path):
    """The part files, by name, hold the same lines as are printed; a second run leaves nothing of the first."""
    data = [(T0 + timedelta(days=i, milliseconds=i % 3 * 250), q, i * q) for i in range(50) for q in range(2)]
    df = spark.createDataFrame(data, "ts timestamp, query_id int, value long")
    for found in (df, df.filter("value < 30")):
        counts.write_lines(found, 2, str(tmp_path / "out"))
        text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
        assert text.splitlines() == list(counts.lines(found, 2))
    assert "2020-01-02 00:00:00.25 [1, 1]" in list(counts.lines(df.withColumn("value", F.lit(1).cast("long")), 2))


@pytest.mark.parametrize("value, shown", [(1 / 3, "0.33333334"), (0.0, "0.0"), (1.0, "1.0"), (0.5, "0.5"), (1e-4, "0.0001"), (0.00012345, "0.00012345"), (9.5e-5, "9.5e-5"), (1e-5, "1e-5"), (1.5e7, "15000000.0"), (float("nan"), "NaN"), (0.002, "0.002"), (12.5, "12.5")])
def test_shortest(spark, value, shown):
    assert spark.range(1).select(counts.shortest(F.lit(value).cast("float"))).first()[0] == shown

"""The dependency graph over time: what requirements resolve to, edges, recent releases, matches, and reachability.

Tables (see ``sources.schema``): releases, dependencies with ``req_key`` (equal for equal requirements), and predicates. All
results carry validity intervals.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import semver
from ..sources.shared import durable, parts_for, stored
from .temporal import FROM, TO, coalesce_intervals, forever, interval_join, running_max_intervals, since, subtract_intervals

#: Names of the features that every release has: the package itself, and its defaults.
PACKAGE, DEFAULT = "", "default"
#: Rounds after which the fixpoint gives up.
MAX_ROUNDS = 65_535
#: Every so many rounds what is known is merged into fewer rows.
MERGE_ROUNDS = 8
#: Rows of a round (some 60 bytes each) up to which they are broadcast.
FEW = 100_000
#: Distinct sets of declared features whose paths a task remembers.
SHAPES = 10_000


def resolved(dependencies: DataFrame, releases: DataFrame) -> DataFrame:
    """(crate_id, req_key, version_id, interval): the greatest matching release as time goes on.

    A requirement that can't take prereleases is a range of stable versions, answered by ``swept``. The others, which are few, are
    compared with the releases of their package one by one.
    """
    wanted = stored(dependencies.select("crate_id", "req_key", "may_pre", "low", "high").distinct())
    stable = swept(wanted.filter("NOT may_pre"), releases)
    offered = releases.select("crate_id", "created_at", F.struct("ver", "version_id").alias("best"))
    unstable = wanted.filter("may_pre").select("crate_id", "req_key", semver.requirement(F.col("req_key")).alias("req"))
    fitting = unstable.join(offered, "crate_id").filter(semver.matches(F.col("req"), F.col("best.ver")))
    best = running_max_intervals(fitting, ["crate_id", "req_key"], "best", "created_at")
    return stable.unionByName(best.select("crate_id", "req_key", F.col("best.version_id").alias("version_id"), FROM, TO))


def swept(wanted: DataFrame, releases: DataFrame) -> DataFrame:
    """(crate_id, req_key, version_id, interval) for requirements (crate_id, req_key, low, high) by their ranges of stable versions.

    A package's stable releases, sorted by version, are each linked to the nearest lesser version that came out earlier. The greatest
    release of a range, and the links from it on as long as they stay inside, are all that the requirement ever resolved to, latest
    first; so work is in proportion to releases, requirements and results, not to their pairs. Spark deals out and sorts by package; a
    task holds one package's releases at a time, some 150 bytes each.
    """
    key = semver.version_key(*(F.col("ver")[n] for n in ("major", "minor", "patch")))
    offered = releases.filter("ver.pre_empty").select("crate_id", key.alias("low"), F.lit(None).cast("string").alias("high"), F.lit(None).cast("string").alias("req_key"), "ver.build", "version_id", F.unix_micros("created_at").alias("at"))
    asked = wanted.filter("crate_id IS NOT NULL AND low < high").select("crate_id", "low", "high", "req_key", F.lit(None).cast(offered.schema["build"].dataType).alias("build"), F.lit(None).cast("long").alias("version_id"), F.lit(None).cast("long").alias("at"))
    rows = offered.unionByName(asked).repartition("crate_id")
    rows = rows.sortWithinPartitions("crate_id", F.col("high").isNotNull(), "low", "build", "version_id").drop("build")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, keys, times, ids, links = None, [], [], [], []
        for batch in batches:
            out = []
            for crate, low, high, req_key, release, at in zip(*(batch[c].to_pylist() for c in ("crate_id", "low", "high", "req_key", "version_id", "at")), strict=True):
                if crate != package:
                    package, keys, times, ids, links = crate, [], [], [], []
                if high is None:  # a release; all of a package's come before its requirements
                    link = len(keys) - 1
                    while link >= 0 and times[link] >= at:
                        link = links[link]
                    keys.append(low), times.append(at), ids.append(release), links.append(link)
                    continue
                i, until = bisect_left(keys, high) - 1, None
                while i >= 0 and keys[i] >= low:
                    out.append((crate, req_key, ids[i], times[i], until))
                    i, until = links[i], times[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["crate_id", "req_key", "version_id", "a", "b"])

    found = rows.mapInArrow(sweep, "crate_id long, req_key string, version_id long, a long, b long")
    return found.select("crate_id", "req_key", "version_id", F.timestamp_micros("a").alias(FROM), F.coalesce(F.timestamp_micros("b"), forever()).alias(TO))


def direct_edges(dependencies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(src, dst, interval): which release a release's dependency rows, of any kind, point to."""
    rows = dependencies.select("crate_id", "req_key", F.col("version_id").alias("src")).distinct()
    return rows.join(_looked_up(resolutions, "dst"), ["crate_id", "req_key"]).select("src", "dst", FROM, TO)


def _looked_up(resolutions: DataFrame, name: str) -> DataFrame:
    """Resolutions to be joined by requirement: a requirement's are far fewer than the rows that ask, so only they are held, hashed, and the others stream past unsorted."""
    return resolutions.withColumnRenamed("version_id", name).hint("shuffle_hash")


def recent(releases: DataFrame) -> DataFrame:
    """(version_id, interval): while a release is its package's latest; any stable one comes before prereleases.

    Where times were clipped to asked dates, ``published_at`` tells which release came later.
    """
    published = "published_at" if "published_at" in releases.columns else "created_at"
    rank = F.struct(F.col("ver.pre_empty").alias("stable"), F.col(published).alias("published"), "version_id")
    best = running_max_intervals(releases.select("crate_id", "created_at", rank.alias("rank")), ["crate_id"], "rank", "created_at")
    return best.select(F.col("rank.version_id").alias("version_id"), FROM, TO)


def matching(predicates: DataFrame, releases: DataFrame) -> DataFrame:
    """(query_id, version_id, interval): releases that any predicate of a query takes; no requirement takes all, prereleases too."""
    wanted = predicates.select("query_id", "crate_id", F.col("req").alias("wanted"))
    rows = releases.join(wanted, "crate_id").filter(F.col("wanted").isNull() | semver.matches(F.col("wanted"), F.col("ver")))
    return since(rows.select("query_id", "version_id", "created_at").distinct(), "created_at").drop("created_at")


def dependents(matches: DataFrame, edges: DataFrame, latest: DataFrame) -> DataFrame:
    """(version_id, query_id, interval): recent releases with an edge to a match. Starts from the matches, the smallest side."""
    to_match = interval_join(edges, matches.withColumnRenamed("version_id", "dst"), ["dst"]).select("src", "query_id", FROM, TO)
    return interval_join(to_match.withColumnRenamed("src", "version_id"), latest, ["version_id"])


def requested_features(default_features: Column, features: Column) -> Column:
    """The features of its target that a dependency turns on; the package alone if it names none and wants no defaults."""
    named = F.when(default_features, F.array(F.lit(DEFAULT))).otherwise(F.array().cast("array<string>"))
    none = ~default_features & (F.size(features) == 0)
    return F.when(none, F.array(F.lit(PACKAGE))).otherwise(F.concat(named, features))


def dependency_edges(dependencies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Edges between (release, feature) nodes from dependency rows other than dev ones."""
    rows = dependencies.filter(F.col("kind").isin("normal", "build")).select("crate_id", "req_key", F.col("version_id").alias("src_v"), F.col("feature").alias("src_f"), F.explode(requested_features(F.col("default_features"), F.col("features"))).alias("dst_f"))
    rows = rows.repartition(parts_for(dependencies), "src_v").distinct()
    return rows.join(_looked_up(resolutions, "dst_v"), ["crate_id", "req_key"]).select("src_v", "src_f", "dst_v", "dst_f", FROM, TO)


def _enabled(releases: DataFrame) -> DataFrame:
    each = releases.select("version_id", "crate_id", "created_at", F.explode("features").alias("f")).select("version_id", "crate_id", "created_at", F.col("f.feature").alias("feature"), F.col("f.enables").alias("enables"))
    return each.select("version_id", "crate_id", "created_at", "feature", F.explode("enables").alias("e")).select("version_id", "crate_id", "created_at", "feature", F.col("e.crate_id").alias("to_crate"), F.col("e.feature").alias("to_feature"))


def own_feature_edges(releases: DataFrame) -> DataFrame:
    """Edges inside a release: features that enable its others, and from every declared one, and the defaults, to the package."""
    columns = ("version_id", "created_at", "src_f", "dst_f")
    own = _enabled(releases).filter("to_crate = crate_id").select("version_id", "created_at", F.col("feature").alias("src_f"), F.col("to_feature").alias("dst_f"))
    declared = releases.select("version_id", "created_at", F.explode("features.feature").alias("src_f")).filter(F.col("src_f") != DEFAULT).withColumn("dst_f", F.lit(PACKAGE))
    always = releases.select("version_id", "created_at", F.lit(DEFAULT).alias("src_f"), F.lit(PACKAGE).alias("dst_f"))
    rows = own.unionByName(declared.select(*columns)).unionByName(always).distinct()
    return since(rows, "created_at").select(F.col("version_id").alias("src_v"), "src_f", F.col("version_id").alias("dst_v"), "dst_f", FROM, TO)


def cross_feature_edges(releases: DataFrame, dependencies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Edges from a feature to a feature of another package that it enables, by the dependency rows (of any kind) on it."""
    enabled = _enabled(releases).filter("to_crate <> crate_id").select("version_id", F.col("to_crate").alias("crate_id"), F.col("feature").alias("src_f"), F.col("to_feature").alias("dst_f")).distinct()
    rows = enabled.join(dependencies.select("version_id", "crate_id", "req_key").distinct(), ["version_id", "crate_id"])
    return rows.join(_looked_up(resolutions, "dst_v"), ["crate_id", "req_key"]).select(F.col("version_id").alias("src_v"), "src_f", "dst_v", "dst_f", FROM, TO)


def feature_edges(releases: DataFrame, dependencies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """All edges between (release, feature) nodes."""
    own = own_feature_edges(releases)
    return dependency_edges(dependencies, resolutions).unionByName(own).unionByName(cross_feature_edges(releases, dependencies, resolutions))


def inner_paths(releases: DataFrame) -> DataFrame:
    """(version_id, feature, above, since): all features of a release that lead to a feature inside the release, by any number of steps.

    A release's own edges hold from its publication on, so their closure does too. Cycles are features above each other. Only
    features that any other leads to have a row.
    """
    own = F.transform(F.col("features"), lambda f: F.transform(F.filter(f["enables"], lambda e: e["crate_id"] == F.col("crate_id")), lambda e: F.struct(f["feature"].alias("src"), e["feature"].alias("dst"))))
    rows = releases.filter("features IS NOT NULL").select("version_id", "created_at", F.flatten(own).alias("own"), "features.feature")
    plain = rows.filter("size(feature) = 0").select("version_id", F.lit(PACKAGE).alias("feature"), F.array(F.lit(DEFAULT)).alias("above"), F.col("created_at").alias("since"))
    shaped = rows.filter("size(feature) > 0").select("version_id", "created_at", F.col("own.src").alias("src"), F.col("own.dst").alias("dst"), "feature")

    def paths(src: list[str], dst: list[str], declared: list[str]) -> dict[str, list[str]]:
        below: dict[str, set[str]] = {DEFAULT: {PACKAGE}}
        for f in declared:
            below.setdefault(f, set()).add(PACKAGE)
        for a, b in zip(src, dst, strict=True):
            below.setdefault(a, set()).add(b)
        above: dict[str, list[str]] = {}
        for start in below:
            seen, todo = {start}, [start]
            while todo:
                for b in below.get(todo.pop(), ()):
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
                        above.setdefault(b, []).append(start)
        return above

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict[str, list[str]]] = {}  # releases of a package mostly declare the same
        for batch in batches:
            ids, names, lists, times = [], [], [], []
            for i, *shape, at in zip(*(batch[c].to_pylist() for c in ("version_id", "src", "dst", "feature", "at")), strict=True):
                key = tuple(map(tuple, shape))
                if key not in known:
                    if len(known) >= SHAPES:
                        known.clear()
                    known[key] = paths(*shape)
                for name, above in known[key].items():
                    ids.append(i), names.append(name), lists.append(above), times.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(lists, pa.list_(pa.string())), pa.array(times, pa.int64())], ["version_id", "feature", "above", "at"])

    made = shaped.withColumn("at", F.unix_micros("created_at")).drop("created_at").mapInArrow(closed, "version_id long, feature string, above array<string>, at long")
    return plain.unionByName(made.select("version_id", "feature", "above", F.timestamp_micros("at").alias("since")))


def outer_edges(releases: DataFrame, dependencies: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The edges between nodes of different releases' dependencies."""
    return dependency_edges(dependencies, resolutions).unionByName(cross_feature_edges(releases, dependencies, resolutions))


def _with_inner(nodes: DataFrame) -> DataFrame:
    """Rows for nodes (version_id, feature, above, since, interval) and for all those that lead to them inside their release."""
    own = F.struct("feature", F.col(FROM).alias("start"))
    more = F.transform(F.coalesce("above", F.array().cast("array<string>")), lambda f: F.struct(f.alias("feature"), F.greatest(F.col(FROM), F.col("since")).alias("start")))
    each = nodes.withColumn("_n", F.explode(F.concat(F.array(own), F.filter(more, lambda n: (n["feature"] != F.col("feature")) & (n["start"] < F.col(TO))))))
    return each.select("version_id", F.col("_n.feature").alias("feature"), "query_id", F.col("_n.start").alias(FROM), TO)


def reachable(matches: DataFrame, releases: DataFrame, edges: DataFrame) -> DataFrame:
    """(version_id, feature, query_id, interval): nodes from which a match can be reached, matches included; intervals are disjoint.

    ``edges`` lead from release to release. What a release's own edges add is known before (``inner_paths``) and comes with the node, so
    a round is one dependency and all that is above it. Semi-naive: each round follows edges backwards from what the last one
    added, less what was known. Intervals are subtracted, so cycles end and a node that is reachable only at times is followed at just these.
    Edges are written once and never dealt out: a round that added few rows broadcasts them, so that it shuffles no edges, and one
    that meets few known rows subtracts them all; else edges and known rows are met by shuffled joins, of which adaptive execution
    splits the hot keys.
    """
    keys = ["version_id", "feature", "query_id"]
    inner = stored(inner_paths(releases))
    back = edges.join(inner.withColumnsRenamed({"version_id": "src_v", "feature": "src_f"}), ["src_v", "src_f"], "left")
    back = stored(back.select(F.col("dst_v").alias("version_id"), F.col("dst_f").alias("feature"), "src_v", "src_f", "above", "since", FROM, TO))
    start = matches.select("version_id", F.lit(PACKAGE).alias("feature"), "query_id", FROM, TO).join(inner, ["version_id", "feature"], "left")
    known = fresh = durable(coalesce_intervals(_with_inner(start), keys))
    n_known = n_fresh = fresh.count()
    for i in range(MAX_ROUNDS):
        if not n_fresh:
            return known
        few = F.broadcast(fresh) if n_fresh <= FEW else fresh
        found = interval_join(back, few, ["version_id", "feature"]).select(F.col("src_v").alias("version_id"), F.col("src_f").alias("feature"), "query_id", "above", "since", FROM, TO)
        found, touched = _with_inner(found), known
        if n_known > FEW:  # what is known of other keys stays where it is
            found = durable(found)
            touched = known.join(found.select(*keys).distinct(), keys, "left_semi")
        fresh = durable(subtract_intervals(found, touched, keys))
        n_fresh = fresh.count()
        known, n_known = known.unionByName(fresh), n_known + n_fresh  # disjoint by construction
        if i % MERGE_ROUNDS == MERGE_ROUNDS - 1:
            known = durable(coalesce_intervals(known, keys))
    raise RuntimeError("the closure doesn't end")


def reaching(reached: DataFrame, latest: DataFrame) -> DataFrame:
    """(version_id, query_id, interval): recent releases of which any feature reaches a match, once for each feature."""
    return interval_join(reached.select("version_id", "query_id", FROM, TO), latest, ["version_id"])

"""Registered queries over the star-schema registry, one or more for each operator family, and their SQL.

The SQL is written independently: it evaluates snapshots at each date instead of intervals, and numbers instead of version structs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, semver
from ..operators import graph, series, temporal
from ..operators.temporal import FROM, TO
from ..sources import dump, repair, star
from ..sources.schema import Registry
from ..sources.shared import parts_for
from . import counts, prepare, query

#: One package, one of its major versions, and either of two packages.
QUERIES_ASKED = ["c7", "c7:^1", "c3 + c5"]
DATES = ("1996-01-01", "1998-01-01", "2001-08-01")
NOW = "2002-01-01 00:00:00"
EXCLUDED = "^c[0-9]*9$"

Query = Callable[[SparkSession, str], DataFrame]


def _at(df: DataFrame, *columns: str, parts: int | None = None) -> DataFrame:
    """The rows that hold at each of DATES; with ``parts`` they are dealt to so many tasks and only there made distinct."""
    rows = temporal.at_dates(df, DATES).select("as_of", *columns)
    return (rows.repartition(parts, "as_of", *columns) if parts else rows).distinct()


def _early(spark: SparkSession, sf_dir: str, features: bool = False) -> DataFrame:
    """Releases as answers at DATES see them."""
    return temporal.clipped(star.releases(spark, sf_dir, features=features), "created_at", DATES)


def running_max_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.recent(star.releases(spark, sf_dir, features=False))


def resolve_requirements_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.resolved(star.dependencies(spark, sf_dir), star.releases(spark, sf_dir, features=False))


def resolve_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At DATES alone."""
    return _at(graph.resolved(star.dependencies(spark, sf_dir), _early(spark, sf_dir)), "crate_id", "req_key", "version_id")


def direct_edges_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each requirement by which a release points to another."""
    deps = graph.stored(star.dependencies(spark, sf_dir))
    return graph.direct_edges(deps, graph.resolved(deps, star.releases(spark, sf_dir, features=False)))


def direct_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At DATES alone."""
    deps = graph.stored(star.dependencies(spark, sf_dir))
    return _at(graph.direct_edges(deps, graph.resolved(deps, _early(spark, sf_dir))), "src", "dst", parts=parts_for(deps))


def _direct_registry(spark: SparkSession, sf_dir: str):
    from dataclasses import replace

    return replace(star.registry(spark, sf_dir), releases=star.releases(spark, sf_dir, features=False))


def match_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _direct_registry(spark, sf_dir)
    found = graph.matching(query.bind(registry, QUERIES_ASKED), registry.releases)
    return found.select("query_id", "version_id", FROM)


def direct_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.over_time(_direct_registry(spark, sf_dir), QUERIES_ASKED[:1])


def direct_series_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.over_time(_direct_registry(spark, sf_dir), QUERIES_ASKED)


def relative_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = counts.over_time(_direct_registry(spark, sf_dir), QUERIES_ASKED, relative=True)
    return found.withColumn("fraction", F.col("fraction").cast("double"))


def chart_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a relative chart draws at each time."""
    found = counts.over_time(_direct_registry(spark, sf_dir), QUERIES_ASKED, relative=True)
    return found.select("ts", "query_id", series.chart_value(F.col("value"), F.col("total")).alias("shown"))


def excluded_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.over_time(_direct_registry(spark, sf_dir), QUERIES_ASKED, exclude_patterns=[EXCLUDED], relative=True).select("ts", "query_id", "value", "total")


def exclude_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.exclude(_direct_registry(spark, sf_dir), [EXCLUDED, "^c1[0-9]$"]).releases.select("version_id", "crate_id", "num")


def requirement_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = prepare.clamp(_direct_registry(spark, sf_dir)).dependencies
    return deps.select("version_id", "crate_id", "req_key", "kind", "feature").distinct()


def dependency_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = star.dependencies(spark, sf_dir)
    wanted = graph.requested_features(F.col("default_features"), F.col("features"))
    return deps.select("version_id", "crate_id", "req_key", "kind", F.explode(wanted).alias("dst_f")).distinct()


def feature_edges_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each requirement, or declaration, by which a node points to another."""
    deps, releases = graph.stored(star.dependencies(spark, sf_dir)), star.releases(spark, sf_dir)
    return graph.feature_edges(releases, deps, graph.stored(graph.resolved(deps, releases)))


def feature_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At DATES alone."""
    deps, releases = graph.stored(star.dependencies(spark, sf_dir)), _early(spark, sf_dir, features=True)
    return _at(graph.feature_edges(releases, deps, graph.stored(graph.resolved(deps, releases))), "src_v", "src_f", "dst_v", "dst_f", parts=parts_for(deps))


def transitive_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.over_time(star.registry(spark, sf_dir), QUERIES_ASKED, transitive=True)


def transitive_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = star.registry(spark, sf_dir)
    predicates = graph.durable(query.bind(registry, QUERIES_ASKED))
    registry = counts.prepared(registry, predicates, transitive=True)
    found = counts.dependents(registry, predicates, transitive=True)
    return temporal.coalesce_intervals(found.select("query_id", "version_id", FROM, TO), ["query_id", "version_id"])


def transitive_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At DATES alone."""
    registry = star.registry(spark, sf_dir)
    predicates = graph.durable(query.bind(registry, QUERIES_ASKED))
    registry = prepare.asked_at(counts.prepared(registry, predicates, transitive=True), DATES)
    return _at(counts.dependents(registry, predicates, transitive=True), "query_id", "version_id")


def owner_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two owners, a user in other case and a team, as predicates."""
    registry = star.registry(spark, sf_dir)
    names_of = [r["owner"] for r in registry.owners.filter("owner_id = 3").orderBy("kind").collect()]
    return query.bind(registry, ["@" + n.swapcase() for n in names_of]).select("query_id", "crate_id")


def owner_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = _direct_registry(spark, sf_dir)
    name = registry.owners.filter("owner_id = 3 AND kind = 'user'").first()["owner"]
    return counts.over_time(registry, ["@" + name])


def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.chart_points(direct_series_multi(spark, sf_dir), F.lit(NOW).cast("timestamp"))


def total_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.totals(star.releases(spark, sf_dir, features=False))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def event_step_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with even ids add and others take away: the net count of each user as it changes."""
    rows = _events(spark, sf_dir).select("user_id", "ts", F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("diff"))
    changes = temporal.consolidate(rows, ["user_id", "ts"])
    return series.cumulative(changes, ["user_id"], "ts", "diff", "net")


def event_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.running_max_intervals(_events(spark, sf_dir), ["user_id", "event_type"], "value", "ts")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user was active, an event counting for six hours: overlapping intervals as one."""
    rows = _events(spark, sf_dir).select("user_id", F.col("ts").alias(FROM), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias(TO))
    return temporal.coalesce_by_days(rows, ["user_id"])


def event_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a user was known but not active: from the first event on, less the sessions."""
    rows = _events(spark, sf_dir)
    known = rows.groupBy("user_id").agg(F.min("ts").alias(FROM)).withColumn(TO, temporal.forever())
    active = rows.select("user_id", F.col("ts").alias(FROM), (F.col("ts") + F.expr("INTERVAL 6 HOURS")).alias(TO))
    return temporal.subtract_by_days(known, active, ["user_id"])


def semver_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct requirement against every distinct version number: the requirements are few (at most 79 texts) and broadcast."""
    return _matching(spark, sf_dir).select("req_key", "num")


def _matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req_key, num, ver): a requirement that can't take prereleases is a range of stable versions, so a pair costs two comparisons; only others are matched by their comparators."""
    reqs = F.broadcast(star.requirements(spark, sf_dir).dropDuplicates(["req_key"]))
    versions = star.releases(spark, sf_dir, features=False).select("num").distinct().withColumn("ver", semver.version(F.col("num")))
    versions = versions.withColumn("_key", semver.version_key(*(F.col("ver")[n] for n in ("major", "minor", "patch"))))
    stable = versions.filter("ver.pre_empty").join(reqs.filter("NOT may_pre").select("req_key", "low", "high"), (F.col("low") <= F.col("_key")) & (F.col("_key") < F.col("high")))
    others = versions.join(reqs.filter("may_pre").select("req_key", "req"), semver.matches(F.col("req"), F.col("ver")))
    return stable.select("req_key", "num", "ver").unionByName(others.select("req_key", "num", "ver"))


def semver_matching_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the version's parts, read from its text."""
    return _matching(spark, sf_dir).select("req_key", "num", *(F.col("ver")[n].cast("long").alias(n) for n in ("major", "minor", "patch")))


def prerelease_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements that name a prerelease, by each operator, against all releases of the same package."""
    releases = star.releases(spark, sf_dir, features=False).select("crate_id", "version_id", "num", "ver")
    sign = F.element_at(F.array(*map(F.lit, ("^", ">=", "~", "<", ">", "<=", "="))), (F.col("version_id") % 7 + 1).cast("int"))
    asked = releases.filter("NOT ver.pre_empty").select("crate_id", F.col("version_id").alias("asked_by"), F.concat(sign, "num").alias("req_text"))
    asked = asked.withColumn("req", semver.requirement(F.col("req_text")))
    return asked.join(releases, "crate_id").filter(semver.matches(F.col("req"), F.col("ver"))).select("asked_by", semver.requirement_text(F.col("req")).alias("req_key"), "version_id")


def requirement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct requirements (at most 79) in their order."""
    reqs = star.requirements(spark, sf_dir).select("req_key", "req").dropDuplicates(["req_key"])
    place = F.row_number().over(Window.orderBy(semver.requirement_order(F.col("req"))))
    return reqs.select("req_key", place.cast("long").alias("place"))


def requirement_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts made from line items spell a version or a requirement: parts left out, leading zeros, wildcards, and numbers out of range."""
    q = F.coalesce(F.floor("l_quantity"), F.lit(0)).cast("string")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tails = ("", ".0", ".0.1", ".01.0", ".1.2-rc.1", ".1.2-rc.01", ".1.2+b.07", ".*", ".x.1", ".18446744073709551615.0", ".18446744073709551616.0", ".111111111111111111111.0")
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("l_partkey") % len(tails) + 1).cast("int"))
    texts = rows.select(F.concat(q, tail).alias("text")).distinct()
    return texts.select("text", semver.version(F.col("text")).isNotNull().alias("is_version"), semver.requirement(F.col("text")).isNotNull().alias("is_requirement"))


def dump_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins of a dump: many users share one, in two spellings, and teams of another service don't count."""
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    login = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    users = customer.select(F.col("c_custkey").alias("id"), login.alias("gh_login"))
    service = F.when(F.col("n_nationkey") % 4 == 0, "gitlab:").otherwise("github:")
    teams = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.concat(service, F.lit("Org"), F.col("n_regionkey").cast("string"), F.lit(":"), "n_name").alias("login"))
    return dump.owners_of(users, teams)


def dump_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared features of a dump: own ones, those of a package by its name or by its new name in a release, and weak ones."""
    packages = star.packages(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("version_id"), F.col("l_suppkey").alias("to"), "l_linenumber")
    items = items.repartition("version_id").distinct()  # the one shuffle of line items: what follows is by release
    name = F.concat(F.lit("c"), F.col("to").cast("string"))
    alias = F.concat(F.lit("al"), F.col("to").cast("string"))
    item = F.when(F.col("l_linenumber") == 1, F.concat(name, F.lit("/x"))).when(F.col("l_linenumber") == 2, F.concat(name, F.lit("?/y"))).when(F.col("l_linenumber") == 3, F.concat(alias, F.lit("/z"))).otherwise("own")
    lists = items.withColumn("item", item).groupBy("version_id").agg(F.sort_array(F.collect_list("item")).alias("made"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("crate_id"))
    text = F.to_json(F.create_map(F.lit("full"), "made", F.lit("none"), F.array().cast("array<string>")))
    versions = orders.join(lists, F.col("id") == F.col("version_id")).select("id", "crate_id", F.lit("1.0.0").alias("num"), text.alias("features"))
    renamed = items.filter("l_linenumber = 3").select(F.col("version_id").alias("id"), "version_id", F.col("to").alias("crate_id"), alias.alias("explicit_name"))
    found = dump.features_of(versions, renamed, packages).select("version_id", F.explode("features").alias("f"))
    found = found.select("version_id", "f.feature", F.size("f.enables").alias("strong"), F.posexplode_outer(F.concat("f.enables", "f.weak_enables")).alias("pos", "e"))
    return found.select("version_id", "feature", (F.col("pos") >= F.col("strong")).alias("weak"), F.col("e.crate_id").alias("to_crate"), F.col("e.feature").alias("to_feature"))


def _dumped(spark: SparkSession, sf_dir: str) -> Registry:
    """The whole loader over a dump made from the tables: names, owners, features, yanked releases, known gaps."""
    return dump.registry_of(star.dump_tables(spark, sf_dir))


def dump_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with those that the dump lacks."""
    return _dumped(spark, sf_dir).packages


def dump_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases that weren't yanked and those that the dump lacks, their place in the semantic order of their package, and what their features enable."""
    rows = _dumped(spark, sf_dir).releases
    place = F.row_number().over(Window.partitionBy("crate_id").orderBy("ver", "version_id"))
    shown = lambda es: F.array_join(F.transform(es, lambda e: F.concat(e["crate_id"].cast("string"), F.lit("/"), e["feature"])), "+")
    features = F.array_join(F.transform("features", lambda f: F.concat(f["feature"], F.lit("="), shown(f["enables"]), F.lit("?"), shown(f["weak_enables"]))), ";")
    return rows.select("version_id", "crate_id", "num", "created_at", place.cast("long").alias("place"), features.alias("features"))


def dump_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies of a dump: defaults folded into one flag, optional and renamed ones by the feature that turns them on."""
    rows = _dumped(spark, sf_dir).dependencies
    return rows.select("dep_id", "version_id", "crate_id", "req_key", "feature", "default_features", F.array_join("features", ",").alias("features"), "kind")


def dump_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dump's requirements, of two comparators and prereleases too, resolved to at all times."""
    registry = _dumped(spark, sf_dir)
    return graph.resolved(registry.dependencies, registry.releases)


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed lines: counts, and shares as the shortest single-precision numbers."""
    found = counts.over_time(_direct_registry(spark, sf_dir), QUERIES_ASKED, relative=True)
    n = len(QUERIES_ASKED)
    return counts.text_lines(found, n).join(counts.text_lines(found, n, relative=True).withColumnRenamed("line", "shares"), "ts")


def text_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a terminal shows of them: the first and last ten with a mark between."""
    found = counts.over_time(_direct_registry(spark, sf_dir), QUERIES_ASKED)
    rows = list(enumerate(counts.lines(found, len(QUERIES_ASKED), head=10)))
    return spark.createDataFrame(rows, "place long, line string")


def chart_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chart's axes span, and what is drawn of each series if a page takes few points: the first, least, greatest and last of each span."""
    points = chart_points(spark, sf_dir).select("query_id", F.unix_millis("ts").alias("ms"), F.col("value").alias("shown"))
    drawn = series.thinned(points, 100, 25)
    axes = series.extents(points.select(F.col("ms").alias("ts"), F.col("shown").alias("value")))
    return drawn.unionByName(axes.select(F.lit(-1).alias("query_id"), F.explode(F.array(F.struct(F.col("first").alias("ms"), F.lit(0).cast("long").alias("shown")), F.struct(F.col("last").alias("ms"), F.col("greatest").alias("shown")))).alias("p")).select("query_id", "p.ms", "p.shown"))


def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_brand")
    made = F.translate("p_name", " ", "_")
    return rows.select("p_partkey", names.package_key(made).alias("package_key"), names.package_is_valid(made).alias("package_valid"), names.user_key(F.col("p_brand")).alias("user_key"), names.user_is_valid(F.col("p_brand")).alias("user_valid"), names.is_team(F.concat_ws("/", "p_brand", "p_name")).alias("team"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        running_max_recent, resolve_requirements, direct_edges, match_releases, direct_series, direct_series_multi, relative_series, excluded_series, exclude_filter,
        requirement_clamp, dependency_features, feature_edges, transitive_series, transitive_snapshot, owner_query, owner_series, chart_points, total_series,
        event_step_series, event_running_max, event_sessions, event_idle, semver_matching, semver_matching_all, name_keys,
        resolve_requirements_over_time, direct_edges_over_time, feature_edges_over_time, transitive_over_time,
        chart_values, prerelease_matching, requirement_order, requirement_texts, dump_owners, dump_features,
        dump_packages, dump_releases, dump_dependencies, dump_resolved, text_lines, text_head, chart_extents,
    )
}


# SQL. A version is a number: major, minor, patch with nine digits each; prereleases match no requirement here.

RELEASES = """rel AS (
  SELECT o_orderkey AS v, o_custkey AS c, o_orderdate::TIMESTAMP AS t, o_orderkey % 3 AS a, (o_orderkey // 3) % 5 AS b, o_orderkey // 15 AS p,
         (o_orderstatus = 'P' AND o_orderkey % 4 = 0) AS pre, (o_orderkey % 3) * 10**12::BIGINT + ((o_orderkey // 3) % 5) * 10**9::BIGINT + o_orderkey // 15 AS n
  FROM orders
)"""
DEPENDENCIES = """dep AS (
  SELECT DISTINCT l_orderkey AS v, l_suppkey AS c, l_linenumber AS op, CAST(coalesce(floor(l_quantity), 0) AS INT) % 3 AS qa, CAST(coalesce(floor(l_quantity), 0) AS INT) % 5 AS qb,
    CASE l_linenumber WHEN 1 THEN '*' WHEN 2 THEN '^' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 3) WHEN 3 THEN '^' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 3) || '.' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 5)
      WHEN 4 THEN '~' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 3) || '.' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 5) WHEN 5 THEN '>=' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 3) || '.' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 5) || '.0'
      WHEN 6 THEN '<' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 3) || '.' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 5) || '.0' ELSE '=' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 3) || '.' || (CAST(coalesce(floor(l_quantity), 0) AS INT) % 5) END AS req,
    CASE WHEN l_returnflag <> 'N' THEN 'dev' WHEN l_linestatus = 'F' THEN 'normal' ELSE 'build' END AS kind,
    CASE WHEN l_tax >= 0.04 THEN 'c' || l_suppkey ELSE '' END AS feature, l_discount < 0.05 AS defaults, l_discount >= 0.08 AS extra
  FROM lineitem
)"""
#: Of a dependency's (or clamped dependency's) comparator and a release, by operator.
FITS = """NOT r.pre AND CASE d.op WHEN 1 THEN TRUE WHEN 2 THEN r.a = d.qa WHEN 3 THEN r.a = d.qa AND (CASE WHEN d.qa > 0 THEN r.b >= d.qb ELSE r.b = d.qb END)
    WHEN 4 THEN r.a = d.qa AND r.b = d.qb WHEN 5 THEN (r.a, r.b, r.p) >= (d.qa, d.qb, 0) WHEN 6 THEN (r.a, r.b, r.p) < (d.qa, d.qb, 0) WHEN 7 THEN r.a = d.qa AND r.b = d.qb
    ELSE r.a = d.qa AND (CASE WHEN d.qa > 0 THEN (r.b, r.p) >= (d.qb, d.qp) WHEN d.qb > 0 THEN r.b = d.qb AND r.p >= d.qp ELSE r.b = d.qb AND r.p = d.qp END) END"""
#: Dependencies with too wide requirements narrowed (operator 8, a full caret), by what had been published by then.
CLAMPED = """best AS (
  SELECT d.v, d.c, max((r.n, r.pre = FALSE)) AS top, arg_max(r.a, (r.n, NOT r.pre)) AS ma, arg_max(r.b, (r.n, NOT r.pre)) AS mb, arg_max(r.p, (r.n, NOT r.pre)) AS mp
  FROM (SELECT DISTINCT v, c FROM dep) d JOIN rel own ON own.v = d.v JOIN rel r ON r.c = d.c AND (r.t, r.v) <= (own.t, own.v) GROUP BY ALL
), narrowed AS (
  SELECT dep.*, best.ma, best.mb, best.mp
  FROM dep LEFT JOIN best ON dep.v = best.v AND dep.c = best.c
), nextv AS (
  SELECT *, CASE WHEN ma > 0 THEN ma + 1 ELSE 0 END AS xa, CASE WHEN ma > 0 THEN 0 WHEN mb > 0 THEN mb + 1 ELSE 0 END AS xb, CASE WHEN ma > 0 OR mb > 0 THEN 0 ELSE mp + 1 END AS xp FROM narrowed
), wide AS (
  SELECT *, ma IS NOT NULL AND CASE op WHEN 1 THEN TRUE WHEN 2 THEN xa = qa WHEN 3 THEN xa = qa AND (CASE WHEN qa > 0 THEN xb >= qb ELSE xb = qb END) WHEN 5 THEN (xa, xb, xp) >= (qa, qb, 0)
      WHEN 6 THEN (xa, xb, xp) < (qa, qb, 0) ELSE xa = qa AND xb = qb END AS is_wide FROM nextv
), cdep AS (
  SELECT v, c, CASE WHEN is_wide THEN 8 ELSE op END AS op, CASE WHEN is_wide THEN ma ELSE qa END AS qa, CASE WHEN is_wide THEN mb ELSE qb END AS qb, CASE WHEN is_wide THEN mp END AS qp,
         CASE WHEN is_wide THEN '^' || ma || '.' || mb || '.' || mp ELSE req END AS req, kind, feature, defaults, extra
  FROM wide
)"""
DATE_LIST = "dates AS (SELECT unnest([" + ", ".join(f"TIMESTAMP '{d}'" for d in DATES) + "]) AS t)"
PREDICATES = "pred(q, c, a) AS (VALUES (0, 7, NULL), (1, 7, 1), (2, 3, NULL), (2, 5, NULL))"
MATCH = "match AS (SELECT DISTINCT pred.q, r.v, r.t FROM pred JOIN rel r ON r.c = pred.c AND (pred.a IS NULL OR (r.a = pred.a AND NOT r.pre)))"
#: Snapshots at every date of a release: what is recent, what requirements resolve to, and so how many depend.
SNAPSHOTS = f"""instants AS (SELECT DISTINCT t FROM rel),
wanted AS (SELECT * FROM cdep WHERE c IN (SELECT c FROM pred)),
reqs AS (SELECT DISTINCT c, op, qa, qb, qp, req FROM wanted),
fits AS (SELECT d.c, d.req, r.t, r.n, r.v FROM reqs d JOIN rel r ON r.c = d.c AND {FITS}),
res AS (SELECT i.t, f.c, f.req, arg_max(f.v, f.n) AS v FROM instants i JOIN fits f ON f.t <= i.t GROUP BY ALL),
target AS (SELECT DISTINCT res.t, res.c, res.req, m.q FROM res JOIN match m ON m.v = res.v AND m.t <= res.t),
latest AS (SELECT i.t, r.c, arg_max(r.v, (NOT r.pre, r.t, r.v)) AS v FROM instants i JOIN rel r ON r.t <= i.t WHERE r.c IN (SELECT rel.c FROM rel JOIN wanted USING (v)) GROUP BY ALL),
counted AS (SELECT t.t, t.q, count(DISTINCT l.v) AS value FROM target t JOIN wanted d ON d.c = t.c AND d.req = t.req JOIN latest l ON l.t = t.t AND l.v = d.v GROUP BY ALL)"""
DENSE = """grid AS (SELECT i.t, q.q, coalesce(x.value, 0) AS value FROM instants i CROSS JOIN (SELECT DISTINCT q FROM pred) q LEFT JOIN counted x ON x.t = i.t AND x.q = q.q),
stepped AS (SELECT t, q, value, coalesce(lag(value) OVER (PARTITION BY q ORDER BY t), 0) AS before FROM grid),
kept AS (SELECT t, q, value FROM stepped WHERE t IN (SELECT t FROM stepped WHERE value <> before))"""
SERIES = f"WITH {RELEASES}, {DEPENDENCIES}, {CLAMPED}, {PREDICATES}, {MATCH}, {SNAPSHOTS}, {DENSE}"
FEATURE_EDGES = """own AS (SELECT v, c, t FROM rel WHERE v % 4 = 0), other AS (SELECT l_orderkey AS v, min(l_suppkey) AS o FROM lineitem GROUP BY ALL),
cross_on AS (SELECT own.v, own.t, 'extra' AS f, other.o AS c, 'std' AS g FROM own JOIN other USING (v) WHERE other.o <> own.c),
inner_edges AS (
  SELECT v, t, 'default' AS f, 'std' AS g FROM own UNION SELECT v, t, 'extra', 'std' FROM own UNION SELECT v, t, 'std', '' FROM own UNION SELECT v, t, 'extra', '' FROM own UNION SELECT v, t, 'default', '' FROM rel
)"""
#: Edges between (release, feature) nodes at each date of ``day``, from dependencies ``dd``.
EDGES = f"""rq AS (SELECT DISTINCT c, op, qa, qb, qp, req FROM dd),
resolved AS (SELECT i.t, d.c, d.req, arg_max(r.v, r.n) AS v FROM day i JOIN rel r ON r.t <= i.t JOIN rq d ON r.c = d.c AND {FITS} GROUP BY ALL),
asked AS (SELECT v, c, req, feature, unnest(CASE WHEN NOT defaults AND NOT extra THEN [''] WHEN defaults AND extra THEN ['default', 'extra'] WHEN defaults THEN ['default'] ELSE ['extra'] END) AS g FROM dd WHERE kind <> 'dev'),
edge AS (
  SELECT x.t, a.v AS sv, a.feature AS sf, x.v AS dv, a.g AS df FROM asked a JOIN resolved x ON x.c = a.c AND x.req = a.req
  UNION SELECT i.t, e.v, e.f, e.v, e.g FROM inner_edges e JOIN day i ON e.t <= i.t
  UNION SELECT x.t, k.v, k.f, x.v, k.g FROM cross_on k JOIN dd ON dd.v = k.v AND dd.c = k.c JOIN resolved x ON x.c = dd.c AND x.req = dd.req
)"""
REACH = """reach AS (
  SELECT i.t, m.q, m.v, '' AS f FROM match m JOIN day i ON m.t <= i.t
  UNION SELECT e.t, r.q, e.sv, e.sf FROM reach r JOIN edge e ON e.t = r.t AND e.dv = r.v AND e.df = r.f
),
newest AS (SELECT i.t, r.c, arg_max(r.v, (NOT r.pre, r.t, r.v)) AS v FROM day i JOIN rel r ON r.t <= i.t GROUP BY ALL),
hit AS (
  SELECT r.t, r.q, r.v FROM reach r
  UNION SELECT x.t, m.q, d.v FROM dd d JOIN resolved x ON x.c = d.c AND x.req = d.req JOIN match m ON m.v = x.v AND m.t <= x.t
),
found AS (SELECT DISTINCT h.t, h.q, h.v FROM hit h JOIN newest n ON n.t = h.t AND n.v = h.v)"""
END = "coalesce(lead(f) OVER (PARTITION BY {k} ORDER BY f), TIMESTAMP '9999-12-31')"

#: What requirements resolve to, as intervals.
RESOLVED = f"""d0 AS (SELECT DISTINCT c, op, qa, qb, NULL AS qp, req FROM dep),
        m AS (SELECT DISTINCT d.c, d.req, r.t AS f, arg_max(r.v, r.n) OVER (PARTITION BY d.c, d.req ORDER BY r.t RANGE UNBOUNDED PRECEDING) AS v FROM rel r JOIN d0 d ON r.c = d.c AND {FITS}),
        s AS (SELECT *, lag(v) OVER (PARTITION BY c, req ORDER BY f) AS was FROM m),
        res AS (SELECT c, req, v, f, {END.format(k='c, req')} AS u FROM s WHERE was IS DISTINCT FROM v)"""

#: The closure over intervals: edges between (release, feature) nodes, what reaches a match along them, and when that release was recent.
CLOSURE = f"""{RESOLVED.replace('FROM dep)', 'FROM cdep)').replace('NULL AS qp', 'qp')}, {FEATURE_EDGES},
asked AS (SELECT DISTINCT v, c, req, feature, unnest(CASE WHEN NOT defaults AND NOT extra THEN [''] WHEN defaults AND extra THEN ['default', 'extra'] WHEN defaults THEN ['default'] ELSE ['extra'] END) AS g FROM cdep WHERE kind <> 'dev'),
iedge AS (
  SELECT a.v AS sv, a.feature AS sf, res.v AS dv, a.g AS dg, res.f, res.u FROM asked a JOIN res ON res.c = a.c AND res.req = a.req
  UNION ALL SELECT v, f, v, g, t, TIMESTAMP '9999-12-31' FROM inner_edges
  UNION ALL SELECT k.v, k.f, res.v, k.g, res.f, res.u FROM cross_on k JOIN (SELECT DISTINCT v, c, req FROM cdep) d ON d.v = k.v AND d.c = k.c JOIN res ON res.c = d.c AND res.req = d.req
),
ireach AS (
  SELECT q, v, '' AS g, t AS f, TIMESTAMP '9999-12-31' AS u FROM match
  UNION SELECT r.q, e.sv, e.sf, greatest(r.f, e.f), least(r.u, e.u) FROM ireach r JOIN iedge e ON e.dv = r.v AND e.dg = r.g AND e.f < r.u AND r.f < e.u
),
nm AS (SELECT DISTINCT c, t AS f, arg_max(v, (NOT pre, t, v)) OVER (PARTITION BY c ORDER BY t RANGE UNBOUNDED PRECEDING) AS v FROM rel),
ns AS (SELECT *, lag(v) OVER (PARTITION BY c ORDER BY f) AS was FROM nm),
nw AS (SELECT v, f, {END.format(k='c')} AS u FROM ns WHERE was IS DISTINCT FROM v),
ihit AS (
  SELECT q, v, f, u FROM ireach
  UNION SELECT m.q, d.v, greatest(res.f, m.t), res.u FROM cdep d JOIN res ON res.c = d.c AND res.req = d.req JOIN match m ON m.v = res.v AND m.t < res.u
),
live AS (SELECT DISTINCT h.q, h.v, greatest(h.f, nw.f) AS f, least(h.u, nw.u) AS u FROM ihit h JOIN nw ON nw.v = h.v AND h.f < nw.u AND nw.f < h.u)"""
CLOSURE = f"WITH RECURSIVE {RELEASES}, {DEPENDENCIES}, {CLAMPED}, {PREDICATES}, {MATCH}, {CLOSURE}"

#: Known gaps: each missing package, release and dependency gets the next id that isn't used.
GAPS = f"""pk(id, name) AS (
  SELECT c_custkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT id, name FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT unnest(range(1, (SELECT max(c_custkey) + 12 FROM customer))) AS id EXCEPT SELECT c_custkey FROM customer)) f
    JOIN (SELECT unnest({repair.PACKAGES}) AS name, unnest(range(1, {len(repair.PACKAGES) + 1})) AS n) USING (n)
), gap_release AS (
  SELECT f.id AS v, pk.id AS c, g.name, g.num, g.t::TIMESTAMP AS t, g.n
  FROM (SELECT *, row_number() OVER () AS n FROM (VALUES {', '.join(map(str, repair.RELEASES))}) x(name, num, t)) g JOIN pk USING (name)
  JOIN (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) + 17 FROM orders))) AS id EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 3)) f USING (n)
), gap_dependency AS (
  SELECT row_number() OVER (ORDER BY r.n, d.n) AS n, r.v, pk.id AS c, CASE WHEN r.num = '0.3.0' AND d.name = 'lazy_static' THEN '^1.0' WHEN r.num = '0.3.0' AND d.name = 'quickcheck' THEN '^0.6' ELSE d.req END AS req, d.feature, d.kind
  FROM gap_release r JOIN (SELECT *, row_number() OVER () AS n FROM (VALUES {', '.join(map(str, repair.PARTIAL_IO_DEPENDENCIES))}) x(name, req, feature, kind)) d ON r.name = 'partial-io' JOIN pk ON pk.name = d.name
)"""
#: A dump's releases: numbers, and prereleases by their place among those that occur.
DUMPED = f"""ranked AS (SELECT unnest(['1', 'a.b', 'alpha', 'alpha.1', 'alpha.2', 'alpha.10']) AS pre, unnest(range(6)) AS rank),
drel AS (
  SELECT o_orderkey AS v, o_custkey AS c, o_orderdate::TIMESTAMP AS t, o_orderkey % 3 AS a, (o_orderkey // 3) % 5 AS b, o_orderkey // 15 AS p,
    CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN ['a.b', 'alpha', 'alpha.1', 'alpha.2', 'alpha.10', '1'][((o_orderkey // 4) % 6 + 1)::INT] END AS pre
  FROM orders WHERE o_orderkey % 7 <> 3),
numbered AS (SELECT drel.*, coalesce(rank, 9) AS rank, a || '.' || b || '.' || p || coalesce('-' || drel.pre, '') AS num FROM drel LEFT JOIN ranked USING (pre)),
ddep AS (
  SELECT DISTINCT l_orderkey AS v, l_suppkey AS c, l_linenumber AS op, q % 3 AS qa, q % 5 AS qb, l_tax >= 0.04 AS optional, cents,
    CASE l_linenumber WHEN 1 THEN '*' WHEN 2 THEN '^' || (q % 3) || '.' || (q % 5) WHEN 3 THEN '>=' || (q % 3) || '.' || (q % 5) || ', <' || (q % 3 + 1) WHEN 4 THEN '~' || (q % 3) || '.' || (q % 5)
      WHEN 5 THEN '>' || (q % 3) || ', <=' || (q % 3 + 1) || '.' || (q % 5) WHEN 6 THEN '>=' || (q % 3) || '.' || (q % 5) || '.0-alpha.2' ELSE '=' || (q % 3) || '.' || (q % 5) END AS req,
    CASE WHEN l_returnflag <> 'N' THEN 'dev' WHEN l_linestatus = 'F' THEN 'normal' ELSE 'build' END AS kind
  FROM (SELECT *, CAST(coalesce(floor(l_quantity), 0) AS INT) AS q, floor(l_discount * 100 + 0.5)::BIGINT AS cents FROM lineitem)
)"""
DUMP_FITS = """CASE d.op WHEN 1 THEN r.rank = 9 WHEN 2 THEN r.rank = 9 AND r.a = d.qa AND (CASE WHEN d.qa > 0 THEN r.b >= d.qb ELSE r.b = d.qb END) WHEN 3 THEN r.rank = 9 AND r.a = d.qa AND r.b >= d.qb
    WHEN 5 THEN r.rank = 9 AND (r.a = d.qa + 1 AND r.b <= d.qb)
    WHEN 6 THEN CASE WHEN r.rank = 9 THEN (r.a, r.b, r.p) >= (d.qa, d.qb, 0) ELSE (r.a, r.b, r.p) = (d.qa, d.qb, 0) AND r.rank >= 4 END ELSE r.rank = 9 AND r.a = d.qa AND r.b = d.qb END"""
#: The shortest text of a single-precision number, with a point.
SHORTEST = "CASE WHEN {0} = 0 THEN '0.0' WHEN {0} < CAST(1e-4 AS FLOAT) THEN regexp_replace(CAST({0} AS VARCHAR), 'e-0', 'e-') ELSE CAST({0} AS VARCHAR) END"

ORACLE_SQL: dict[str, str] = {
    "dump_packages": f"WITH {GAPS} SELECT id AS crate_id, name FROM pk",
    "dump_releases": f"""WITH {GAPS}, {DUMPED}, other AS (SELECT l_orderkey AS v, min(l_suppkey) AS o, min(l_suppkey) FILTER (l_linenumber = 3) AS w FROM lineitem GROUP BY ALL),
        every AS (SELECT v, c, num, t, a, b, p, rank FROM numbered UNION ALL SELECT v, c, num, t, split_part(num, '.', 1)::BIGINT, split_part(num, '.', 2)::BIGINT, split_part(num, '.', 3)::BIGINT, 9 FROM gap_release)
        SELECT e.v AS version_id, e.c AS crate_id, e.num, e.t AS created_at, row_number() OVER (PARTITION BY e.c ORDER BY e.a, e.b, e.p, e.rank, e.v) AS place,
          CASE WHEN g.name = 'partial-io' THEN 'tokio=' || e.c || '/tokio-io+' || e.c || '/futures?' WHEN g.v IS NOT NULL OR e.v % 4 <> 0 THEN ''
            ELSE 'default=' || e.c || '/std?;extra=' || e.c || '/std' || coalesce('+' || o || '/std', '') || '?' || coalesce(w || '/x', '') || ';std=?' END AS features
        FROM every e LEFT JOIN gap_release g ON g.v = e.v LEFT JOIN other ON other.v = e.v""",
    "dump_dependencies": f"""WITH {GAPS}, {DUMPED}, unused AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT unnest(range(0, 10000)) AS id EXCEPT SELECT v * 8 + op FROM ddep))
        SELECT v * 8 + op AS dep_id, v AS version_id, c AS crate_id, req AS req_key, CASE WHEN NOT optional THEN '' WHEN op = 3 THEN 'al' || c ELSE 'c' || c END AS feature, cents < 3 OR cents % 4 >= 2 AS default_features,
          ['', 'extra', '', 'extra,std'][(cents % 4 + 1)::INT] AS features, kind FROM ddep
        UNION ALL SELECT id, v, c, req, feature, TRUE, '', kind FROM gap_dependency JOIN unused USING (n)""",
    "dump_resolved": f"""WITH {GAPS}, {DUMPED}, d0 AS (SELECT DISTINCT c, op, qa, qb, req FROM ddep),
        m AS (SELECT DISTINCT d.c, d.req, r.t AS f, arg_max(r.v, (r.a, r.b, r.p, r.rank)) OVER (PARTITION BY d.c, d.req ORDER BY r.t RANGE UNBOUNDED PRECEDING) AS v FROM numbered r JOIN d0 d ON r.c = d.c AND {DUMP_FITS}),
        s AS (SELECT *, lag(v) OVER (PARTITION BY c, req ORDER BY f) AS was FROM m)
        SELECT c AS crate_id, req AS req_key, v AS version_id, f AS valid_from, {END.format(k='c, req')} AS valid_to FROM s WHERE was IS DISTINCT FROM v""",
    "text_lines": f"""{SERIES}, born AS (SELECT c, min(t) AS t FROM rel GROUP BY c), total AS (SELECT i.t, count(*) AS total FROM instants i JOIN born ON born.t <= i.t GROUP BY ALL),
        shares AS (SELECT k.t, k.q, k.value, CAST(k.value AS FLOAT) / CAST(total AS FLOAT) AS x FROM kept k JOIN total USING (t))
        SELECT t AS ts, strftime(t, '%Y-%m-%d %H:%M:%S') || ' [' || string_agg(value::VARCHAR, ', ' ORDER BY q) || ']' AS line,
          strftime(t, '%Y-%m-%d %H:%M:%S') || ' [' || string_agg({SHORTEST.format('CAST(x AS FLOAT)')}, ', ' ORDER BY q) || ']' AS shares FROM shares GROUP BY t""",
    "text_head": f"""{SERIES}, written AS (SELECT strftime(t, '%Y-%m-%d %H:%M:%S') || ' [' || string_agg(value::VARCHAR, ', ' ORDER BY q) || ']' AS line, row_number() OVER (ORDER BY t) - 1 AS i, count(*) OVER () AS n FROM kept GROUP BY t)
        SELECT CASE WHEN n <= 20 OR i < 10 THEN i ELSE i - n + 21 END AS place, line FROM written WHERE n <= 20 OR i < 10 OR i >= n - 10 UNION ALL SELECT 10, '...' FROM (SELECT DISTINCT n FROM written) WHERE n > 20""",
    "running_max_recent": f"""WITH {RELEASES}, m AS (SELECT c, t AS f, arg_max(v, (NOT pre, t, v)) OVER (PARTITION BY c ORDER BY t RANGE UNBOUNDED PRECEDING) AS v FROM rel),
        k AS (SELECT DISTINCT c, f, v FROM m), s AS (SELECT *, lag(v) OVER (PARTITION BY c ORDER BY f) AS was FROM k)
        SELECT v AS version_id, f AS valid_from, {END.format(k='c')} AS valid_to FROM s WHERE was IS DISTINCT FROM v""",
    "resolve_requirements": f"""WITH {RELEASES}, {DEPENDENCIES}, {DATE_LIST}, d0 AS (SELECT DISTINCT c, op, qa, qb, NULL AS qp, req FROM dep)
        SELECT dates.t AS as_of, d.c AS crate_id, d.req AS req_key, arg_max(r.v, r.n) AS version_id FROM dates JOIN rel r ON r.t <= dates.t JOIN d0 d ON r.c = d.c AND {FITS} GROUP BY ALL""",
    "direct_edges": f"""WITH {RELEASES}, {DEPENDENCIES}, {DATE_LIST}, d0 AS (SELECT DISTINCT c, op, qa, qb, NULL AS qp, req FROM dep),
        x AS (SELECT dates.t, d.c, d.req, arg_max(r.v, r.n) AS v FROM dates JOIN rel r ON r.t <= dates.t JOIN d0 d ON r.c = d.c AND {FITS} GROUP BY ALL)
        SELECT DISTINCT x.t AS as_of, dep.v AS src, x.v AS dst FROM x JOIN dep ON dep.c = x.c AND dep.req = x.req""",
    "match_releases": f"WITH {RELEASES}, {PREDICATES}, {MATCH} SELECT q AS query_id, v AS version_id, t AS valid_from FROM match",
    "direct_series": SERIES.replace(PREDICATES, "pred(q, c, a) AS (VALUES (0, 7, CAST(NULL AS INT)))") + " SELECT t AS ts, q AS query_id, value FROM kept",
    "direct_series_multi": f"{SERIES} SELECT t AS ts, q AS query_id, value FROM kept",
    "relative_series": f"""{SERIES}, born AS (SELECT c, min(t) AS t FROM rel GROUP BY c)
        SELECT k.t AS ts, k.q AS query_id, k.value, b.total, CAST(CAST(k.value AS FLOAT) / CAST(b.total AS FLOAT) AS DOUBLE) AS fraction FROM kept k JOIN (SELECT i.t, count(*) AS total FROM instants i JOIN born ON born.t <= i.t GROUP BY ALL) b ON b.t = k.t""",
    "chart_values": f"""{SERIES}, born AS (SELECT c, min(t) AS t FROM rel GROUP BY c)
        SELECT k.t AS ts, k.q AS query_id, CASE WHEN b.total = 0 THEN 0.0 WHEN k.value = b.total THEN 0.5 ELSE CAST(CAST(k.value AS FLOAT) / CAST(b.total AS FLOAT) AS DOUBLE) END AS shown
        FROM kept k JOIN (SELECT i.t, count(*) AS total FROM instants i JOIN born ON born.t <= i.t GROUP BY ALL) b ON b.t = k.t""",
    "excluded_series": f"""{SERIES.replace('FROM orders', 'FROM orders WHERE o_custkey % 10 <> 9')}, born AS (SELECT c, min(t) AS t FROM rel GROUP BY c)
        SELECT k.t AS ts, k.q AS query_id, k.value, b.total FROM kept k JOIN (SELECT i.t, count(*) AS total FROM instants i JOIN born ON born.t <= i.t GROUP BY ALL) b ON b.t = k.t""",
    "exclude_filter": f"""WITH {RELEASES} SELECT v AS version_id, c AS crate_id, a || '.' || b || '.' || p || CASE WHEN pre THEN '-alpha' ELSE '' END AS num FROM rel
        WHERE NOT regexp_matches('c' || c, '{EXCLUDED}') AND NOT regexp_matches('c' || c, '^c1[0-9]$')""",
    "requirement_clamp": f"WITH {RELEASES}, {DEPENDENCIES}, {CLAMPED} SELECT DISTINCT v AS version_id, c AS crate_id, req AS req_key, kind, feature FROM cdep",
    "dependency_features": f"""WITH {DEPENDENCIES} SELECT DISTINCT v AS version_id, c AS crate_id, req AS req_key, kind,
        unnest(CASE WHEN NOT defaults AND NOT extra THEN [''] WHEN defaults THEN ['default'] ELSE ['extra'] END) AS dst_f FROM dep""",
    "feature_edges": f"""WITH {RELEASES}, {DEPENDENCIES}, day AS (SELECT unnest([{', '.join(f"TIMESTAMP '{d}'" for d in DATES)}]) AS t), dd AS (SELECT *, NULL AS qp FROM dep), {FEATURE_EDGES}, {EDGES}
        SELECT t AS as_of, sv AS src_v, sf AS src_f, dv AS dst_v, df AS dst_f FROM edge""",
    "transitive_snapshot": f"""WITH RECURSIVE {RELEASES}, {DEPENDENCIES}, {CLAMPED}, {PREDICATES}, {MATCH}, day AS (SELECT unnest([{', '.join(f"TIMESTAMP '{d}'" for d in DATES)}]) AS t), dd AS (SELECT * FROM cdep),
        {FEATURE_EDGES}, {EDGES}, {REACH} SELECT t AS as_of, q AS query_id, v AS version_id FROM found""",
    "transitive_series": f"""{CLOSURE}, instants AS (SELECT DISTINCT t FROM rel),
        counted AS (SELECT i.t, l.q, count(DISTINCT l.v) AS value FROM instants i JOIN live l ON l.f <= i.t AND i.t < l.u GROUP BY ALL), {DENSE} SELECT t AS ts, q AS query_id, value FROM kept""",
    "transitive_over_time": f"""{CLOSURE}, reached AS (SELECT *, max(u) OVER (PARTITION BY q, v ORDER BY f, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM live),
        numbered AS (SELECT *, count(*) FILTER (high IS NULL OR f > high) OVER (PARTITION BY q, v ORDER BY f, u) AS n FROM reached)
        SELECT q AS query_id, v AS version_id, min(f) AS valid_from, max(u) AS valid_to FROM numbered GROUP BY q, v, n""",
    "owner_query": """WITH k AS (SELECT s_suppkey AS crate_id FROM supplier WHERE s_nationkey = 3) SELECT unnest([0, 1]) AS query_id, crate_id FROM k""",
    "owner_series": SERIES.replace(PREDICATES, "pred(q, c, a) AS (SELECT 0, s_suppkey, CAST(NULL AS INT) FROM supplier WHERE s_nationkey = 3)") + " SELECT t AS ts, q AS query_id, value FROM kept",
    "chart_points": f"""{SERIES}, seen AS (SELECT *, max(value) OVER (PARTITION BY q ORDER BY t) AS top FROM kept), started AS (SELECT *, lag(value) OVER (PARTITION BY q ORDER BY t) AS was FROM seen WHERE top > 0)
        SELECT q AS query_id, CASE WHEN date_trunc('second', t) = t THEN t - INTERVAL 1 SECOND ELSE date_trunc('second', t) END AS ts, 0::BIGINT AS value FROM started WHERE was IS NULL
        UNION ALL SELECT q, t, value FROM started WHERE was IS NULL OR was <> value
        UNION ALL SELECT q, TIMESTAMP '{NOW}', arg_max(value, t) FROM kept GROUP BY q""",
    "total_series": f"WITH {RELEASES}, born AS (SELECT c, min(t) AS t FROM rel GROUP BY c) SELECT DISTINCT t AS ts, count(*) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS total FROM born",
    "event_step_series": """WITH d AS (SELECT user_id, ts, sum(CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS diff FROM events GROUP BY ALL)
        SELECT user_id, ts, CAST(sum(diff) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS net FROM d WHERE diff <> 0""",
    "event_running_max": """WITH m AS (SELECT DISTINCT user_id, event_type, ts AS f, max(value) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS value FROM events),
        s AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY f) AS was FROM m)
        SELECT user_id, event_type, value, f AS valid_from, """ + END.format(k="user_id, event_type") + " AS valid_to FROM s WHERE was IS DISTINCT FROM value",
    "event_sessions": """WITH e AS (SELECT DISTINCT user_id, ts FROM events), g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS was FROM e),
        s AS (SELECT *, count(*) FILTER (was IS NULL OR ts > was + INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
        SELECT user_id, min(ts) AS valid_from, max(ts) + INTERVAL 6 HOUR AS valid_to FROM s GROUP BY user_id, n""",
    "event_idle": """WITH e AS (SELECT DISTINCT user_id, ts FROM events), g AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next FROM e)
        SELECT user_id, ts + INTERVAL 6 HOUR AS valid_from, coalesce(next, TIMESTAMP '9999-12-31') AS valid_to FROM g WHERE next IS NULL OR next > ts + INTERVAL 6 HOUR""",
    "semver_matching": f"""WITH {RELEASES}, {DEPENDENCIES}, d0 AS (SELECT DISTINCT op, qa, qb, NULL AS qp, req FROM dep)
        SELECT DISTINCT d.req AS req_key, r.a || '.' || r.b || '.' || r.p AS num FROM rel r JOIN d0 d ON {FITS}""",
    "semver_matching_all": f"""WITH {RELEASES}, {DEPENDENCIES}, d0 AS (SELECT DISTINCT op, qa, qb, NULL AS qp, req FROM dep)
        SELECT DISTINCT d.req AS req_key, r.a || '.' || r.b || '.' || r.p AS num, r.a AS major, r.b AS minor, r.p AS patch FROM rel r JOIN d0 d ON {FITS}""",
    "prerelease_matching": f"""WITH {RELEASES}, x AS (SELECT *, ['^', '>=', '~', '<', '>', '<=', '='][(v % 7 + 1)::INT] AS s FROM rel WHERE pre)
        SELECT x.v AS asked_by, x.s || x.a || '.' || x.b || '.' || x.p || '-alpha' AS req_key, r.v AS version_id FROM x JOIN rel r ON r.c = x.c AND CASE
          WHEN r.pre THEN (r.a, r.b, r.p) = (x.a, x.b, x.p) AND x.s NOT IN ('<', '>')
          WHEN x.s = '^' THEN r.a = x.a AND CASE WHEN x.a > 0 THEN (r.b, r.p) >= (x.b, x.p) WHEN x.b > 0 THEN r.b = x.b AND r.p >= x.p ELSE r.b = x.b AND r.p = x.p END
          WHEN x.s = '~' THEN r.a = x.a AND r.b = x.b AND r.p >= x.p
          WHEN x.s IN ('>', '>=') THEN (r.a, r.b, r.p) >= (x.a, x.b, x.p)
          WHEN x.s IN ('<', '<=') THEN (r.a, r.b, r.p) < (x.a, x.b, x.p) ELSE FALSE END""",
    "requirement_order": f"""WITH {DEPENDENCIES}, one AS (SELECT req, any_value(op) AS op, any_value(qa) AS qa, any_value(qb) AS qb FROM dep GROUP BY req)
        SELECT req AS req_key, row_number() OVER (ORDER BY CASE op WHEN 1 THEN -1 WHEN 2 THEN 6 WHEN 3 THEN 6 WHEN 4 THEN 5 WHEN 5 THEN 2 WHEN 6 THEN 3 ELSE 0 END, qa, op = 3, qb) AS place FROM one""",
    "requirement_texts": """WITH t AS (SELECT DISTINCT CAST(coalesce(floor(l_quantity), 0) AS BIGINT) AS q, (l_partkey % 12)::INT AS k FROM lineitem),
        tails(k, tail, v, r) AS (VALUES (0, '', FALSE, TRUE), (1, '.0', FALSE, TRUE), (2, '.0.1', TRUE, TRUE), (3, '.01.0', FALSE, FALSE), (4, '.1.2-rc.1', TRUE, TRUE), (5, '.1.2-rc.01', FALSE, FALSE),
          (6, '.1.2+b.07', TRUE, TRUE), (7, '.*', FALSE, TRUE), (8, '.x.1', FALSE, FALSE), (9, '.18446744073709551615.0', TRUE, TRUE), (10, '.18446744073709551616.0', FALSE, FALSE), (11, '.111111111111111111111.0', FALSE, FALSE))
        SELECT q || tail AS text, v AS is_version, r AS is_requirement FROM t JOIN tails USING (k)""",
    "dump_owners": """SELECT arg_min(CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END, c_custkey) AS owner, 'user' AS kind, max(c_custkey) AS owner_id FROM customer GROUP BY lower(c_mktsegment)
        UNION ALL SELECT 'Org' || n_regionkey || '/' || n_name, 'team', n_nationkey::BIGINT FROM nation WHERE n_nationkey % 4 <> 0""",
    "dump_features": """WITH i AS (SELECT DISTINCT l_orderkey AS v, l_suppkey AS c, l_linenumber AS n FROM lineitem)
        SELECT v AS version_id, 'full' AS feature, n = 2 AS weak, CASE WHEN n <= 3 THEN i.c ELSE o_custkey END AS to_crate, CASE n WHEN 1 THEN 'x' WHEN 2 THEN 'y' WHEN 3 THEN 'z' ELSE 'own' END AS to_feature FROM i JOIN orders ON o_orderkey = v
        UNION ALL SELECT DISTINCT v, 'none', NULL, NULL, NULL FROM i JOIN orders ON o_orderkey = v""",
    "resolve_requirements_over_time": f"WITH {RELEASES}, {DEPENDENCIES}, {RESOLVED} SELECT c AS crate_id, req AS req_key, v AS version_id, f AS valid_from, u AS valid_to FROM res",
    "direct_edges_over_time": f"""WITH {RELEASES}, {DEPENDENCIES}, {RESOLVED}
        SELECT d.v AS src, res.v AS dst, f AS valid_from, u AS valid_to FROM (SELECT DISTINCT v, c, req FROM dep) d JOIN res ON res.c = d.c AND res.req = d.req""",
    "feature_edges_over_time": f"""WITH {RELEASES}, {DEPENDENCIES}, {RESOLVED}, {FEATURE_EDGES},
        asked AS (SELECT DISTINCT v, c, req, feature, unnest(CASE WHEN NOT defaults AND NOT extra THEN [''] WHEN defaults AND extra THEN ['default', 'extra'] WHEN defaults THEN ['default'] ELSE ['extra'] END) AS g FROM dep WHERE kind <> 'dev')
        SELECT a.v AS src_v, a.feature AS src_f, res.v AS dst_v, a.g AS dst_f, res.f AS valid_from, u AS valid_to FROM asked a JOIN res ON res.c = a.c AND res.req = a.req
        UNION ALL SELECT v, f, v, g, t, TIMESTAMP '9999-12-31' FROM inner_edges
        UNION ALL SELECT k.v, k.f, res.v, k.g, res.f, u FROM cross_on k JOIN (SELECT DISTINCT v, c, req FROM dep) d ON d.v = k.v AND d.c = k.c JOIN res ON res.c = d.c AND res.req = d.req""",
    "name_keys": """SELECT p_partkey, replace(replace(p_name, ' ', '_'), '_', '-') AS package_key, regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z][A-Za-z0-9_-]{0,63}$') AS package_valid,
        lower(p_brand) AS user_key, regexp_matches(p_brand, '^[0-9A-Za-z]+(-[0-9A-Za-z]+)*$') AND length(p_brand) <= 39 AS user_valid, contains(p_brand || '/' || p_name, '/') AS team FROM part""",
}
ORACLE_SQL["chart_extents"] = f"""WITH points AS (SELECT query_id, epoch_ms(ts) AS ms, value AS shown FROM ({ORACLE_SQL['chart_points']})),
    whole AS (SELECT *, count(*) OVER w AS n, (ms - min(ms) OVER w) * 25 // (max(ms) OVER w - min(ms) OVER w + 1) AS span FROM points WINDOW w AS (PARTITION BY query_id)),
    kept AS (SELECT query_id, min((ms, shown)) AS a, max((ms, shown)) AS b, min((shown, ms)) AS c, max((shown, ms)) AS d FROM whole WHERE n > 100 GROUP BY query_id, span)
    SELECT query_id, ms, shown FROM whole WHERE n <= 100
    UNION ALL SELECT DISTINCT query_id, ms, shown FROM (SELECT query_id, unnest([a[1], b[1], c[2], d[2]]) AS ms, unnest([a[2], b[2], c[1], d[1]]) AS shown, unnest(range(4)) FROM kept)
    UNION ALL SELECT -1, min(ms), 0 FROM points UNION ALL SELECT -1, max(ms), max(shown) FROM points"""
#: The closure at every date of a release: the snapshot's SQL with all dates. Too slow for any but the smallest tables, so it
#: is run by the tests alone.
TRANSITIVE_SERIES_SQL = f"""WITH RECURSIVE {RELEASES}, {DEPENDENCIES}, {CLAMPED}, {PREDICATES}, {MATCH}, instants AS (SELECT DISTINCT t FROM rel), day AS (SELECT t FROM instants), dd AS (SELECT * FROM cdep),
    {FEATURE_EDGES}, {EDGES}, {REACH}, counted AS (SELECT t, q, count(*) AS value FROM found GROUP BY ALL), {DENSE} SELECT t AS ts, q AS query_id, value FROM kept"""
#: The same closure as intervals, for the tests as well.
TRANSITIVE_OVER_TIME_SQL = f"""WITH RECURSIVE {RELEASES}, {DEPENDENCIES}, {CLAMPED}, {PREDICATES}, {MATCH}, instants AS (SELECT DISTINCT t FROM rel), day AS (SELECT t FROM instants), dd AS (SELECT * FROM cdep),
    {FEATURE_EDGES}, {EDGES}, {REACH}, numbered AS (SELECT t, row_number() OVER (ORDER BY t) AS i, coalesce(lead(t) OVER (ORDER BY t), TIMESTAMP '9999-12-31') AS u FROM instants),
    runs AS (SELECT q, v, t, u, i - row_number() OVER (PARTITION BY q, v ORDER BY i) AS run FROM found JOIN numbered USING (t))
    SELECT q AS query_id, v AS version_id, min(t) AS valid_from, max(u) AS valid_to FROM runs GROUP BY q, v, run"""

"""The whole plan: how many packages depended on each query's releases, at every time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph, series
from ..operators.temporal import FROM, TO
from ..sources.schema import Registry
from .prepare import clamp, exclude
from .query import bind


def prepared(registry: Registry, predicates: DataFrame, transitive: bool = False, exclude_patterns: Sequence[str] = ()) -> Registry:
    """The registry as the dataflow reads it. Direct counts need only the dependencies on the queries' packages, the closure reads releases often."""
    registry = exclude(registry, exclude_patterns)
    if transitive:
        registry = replace(registry, releases=graph.stored(registry.releases))
    if not transitive:
        wanted = predicates.select("crate_id").distinct()
        registry = replace(registry, dependencies=registry.dependencies.join(wanted, "crate_id", "left_semi").select(registry.dependencies.columns))
    return replace(registry, dependencies=graph.stored(clamp(registry).dependencies))


def dependents(registry: Registry, predicates: DataFrame, transitive: bool = False) -> DataFrame:
    """(version_id, query_id, interval): recent releases that depend on a query's matches, directly or, with ``transitive``, through features."""
    releases, dependencies = registry.releases, registry.dependencies
    matches = graph.matching(predicates, releases)
    latest = graph.recent(releases)
    if not transitive:
        resolutions = graph.resolved(dependencies, releases)
        return graph.dependents(matches, graph.direct_edges(dependencies, resolutions), latest)
    resolutions = graph.stored(graph.resolved(dependencies, releases))
    near = dependencies.join(predicates.select("crate_id").distinct(), "crate_id", "left_semi")  # only these can point to a match
    direct = graph.dependents(matches, graph.direct_edges(near, resolutions), latest)
    reached = graph.reachable(matches, releases, graph.outer_edges(releases, dependencies, resolutions))
    return direct.select("version_id", "query_id", FROM, TO).unionByName(graph.reaching(reached, latest).select("version_id", "query_id", FROM, TO))


def over_time(registry: Registry, queries: Iterable[str], transitive: bool = False, exclude_patterns: Sequence[str] = (), relative: bool = False) -> DataFrame:
    """(ts, query_id, value[, total, fraction]): a row for each query at each time at which any query's count changes.

    The change log is checkpointed: it is as small as the result, and what follows reads it several times.
    """
    queries = list(queries)
    predicates = graph.durable(bind(registry, queries))
    registry = prepared(registry, predicates, transitive, exclude_patterns)
    counts = graph.durable(series.count_changes(dependents(registry, predicates, transitive)))
    found = series.integrate(counts, list(range(len(queries))))
    return series.relative(found, registry.releases) if relative else found


def text_lines(found: DataFrame, n_queries: int, relative: bool = False) -> DataFrame:
    """(ts, line): the series as text, a line for each time with the values in the queries' order, made by the executors."""
    table = series.wide(found, list(range(n_queries)), "fraction" if relative else "value")
    shown = F.regexp_replace(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0*$", "")
    values = F.transform("values", lambda v: F.coalesce(shortest(v.cast("float")) if relative else v.cast("string"), F.lit("NaN")))
    return table.select("ts", F.concat(shown, F.lit(" ["), F.array_join(values, ", "), F.lit("]")).alias("line"))


def shortest(value: Column) -> Column:
    """A single-precision number in the fewest digits that tell it apart: with a point, or with an exponent below 1e-4 and from 1e16 on."""
    text = value.cast("string")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"\.0$", "")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    bare = F.regexp_replace(digits, r"\.", "")
    far = F.concat(digits, F.lit("e"), exponent.cast("string"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), bare)
    large = F.concat(F.rpad(bare, F.greatest(exponent + 1, F.length(bare)), F.lit("0")), F.lit(".0"))
    size = F.abs(value)
    plain = F.when(exponent.isNull(), text).when((size < F.lit(1e-4).cast("float")) | (size >= 1e16), F.concat(sign, far)).when(exponent < 0, F.concat(sign, small)).otherwise(F.concat(sign, large))
    return F.when(F.isnan(value), "NaN").otherwise(plain)


def write_lines(found: DataFrame, n_queries: int, path: str, relative: bool = False) -> None:
    """The text of ``lines`` in part files whose names are in the order of time; a re-run replaces them all."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = text_lines(found, n_queries, relative).repartitionByRange(parts, "ts").sortWithinPartitions("ts")
    rows.select("line").write.mode("overwrite").text(path)


def lines(found: DataFrame, n_queries: int, relative: bool = False, head: int | None = None) -> Iterator[str]:
    """The text's lines, which come to the driver a partition at a time; with ``head`` only so many first and last lines if there are over twice as many."""
    table = text_lines(found, n_queries, relative)
    if head is None:
        yield from (r["line"] for r in table.orderBy("ts").toLocalIterator())
        return
    first = table.orderBy("ts").limit(2 * head + 1).collect()
    if len(first) <= 2 * head:
        yield from (r["line"] for r in first)
        return
    yield from (r["line"] for r in first[:head])
    yield "..."
    yield from (r["line"] for r in table.orderBy(F.desc("ts")).limit(head).collect()[::-1])

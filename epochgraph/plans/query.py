"""The query language: ``package``, ``package:requirement``, ``@owner``, joined by ``+``; checked, bound to tables, and labelled."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, semver
from ..sources.schema import PREDICATES, Registry

#: Queries of one run are numbered in one byte.
MAX_QUERIES = 256


class QueryError(ValueError):
    """A query that is malformed or names something unknown."""


@dataclass(frozen=True)
class Package:
    name: str
    requirement: tuple[semver.Comparator, ...] | None


@dataclass(frozen=True)
class Owner:
    name: str


def check(query: str) -> str:
    """The query, if its form is right; names need not exist yet."""
    for part in (p.strip() for p in query.split("+")):
        if part.startswith("@"):
            if not all(map(names.valid_user, part[1:].split("/"))):
                raise QueryError("invalid username")
            continue
        name, colon, requirement = part.partition(":")
        if not names.valid_package(name.strip()):
            raise QueryError("invalid package name")
        if colon:
            _requirement(requirement)
    return query


def _requirement(text: str) -> tuple[semver.Comparator, ...]:
    try:
        return semver.parse_requirement(text)
    except semver.RequirementError as e:
        raise QueryError(str(e)) from e


def parse(query: str) -> list[Package | Owner]:
    """The predicates of a query. A name keeps the spaces before its colon, and is then not found."""
    out: list[Package | Owner] = []
    for part in (p.strip() for p in query.split("+")):
        if part.startswith("@"):
            out.append(Owner(part[1:]))
        else:
            name, colon, requirement = part.partition(":")
            out.append(Package(name, _requirement(requirement) if colon else None))
    return out


def _look_up(registry: Registry, parsed: list[list[Package | Owner]]) -> tuple[dict[str, tuple[int, str]], dict[str, tuple[str, int, str]]]:
    """The packages and owners that the queries name, by key: a few rows each, however large the registry."""
    packages = sorted({p.name.replace("_", "-") for q in parsed for p in q if isinstance(p, Package)})
    owners = sorted({p.name.lower() for q in parsed for p in q if isinstance(p, Owner)})
    found = registry.packages.withColumn("key", names.package_key(F.col("name"))).filter(F.col("key").isin(packages)).collect() if packages else []
    held = registry.owners.withColumn("key", names.user_key(F.col("owner"))).filter(F.col("key").isin(owners)).collect() if owners else []
    return {r["key"]: (r["crate_id"], r["name"]) for r in found}, {r["key"]: (r["kind"], r["owner_id"], r["owner"]) for r in held}


def bind(registry: Registry, queries: Iterable[str]) -> DataFrame:
    """Predicates (query_id, crate_id, req) of the queries, an owner's packages each as one without requirement.

    An unknown package or owner is an error; an owner without packages just has no predicates.
    """
    queries = list(queries)
    if len(queries) > MAX_QUERIES:
        raise QueryError(f"more than {MAX_QUERIES} queries")
    parsed = []
    for q in queries:
        try:
            parsed.append(parse(q))
        except QueryError as e:
            raise QueryError(f"failed to parse query {q!r}: {e}") from e
    packages, owners = _look_up(registry, parsed)
    spark: SparkSession = registry.packages.sparkSession
    named, owning = [], []
    for i, (query, predicates) in enumerate(zip(queries, parsed, strict=True)):
        for p in predicates:
            if isinstance(p, Owner):
                if p.name.lower() not in owners:
                    kind = "team" if "/" in p.name else "user"
                    raise QueryError(f"failed to parse query {query!r}: no crates owned by {kind} @{p.name}")
                owning.append((i, *owners[p.name.lower()][:2]))
            else:
                if p.name.replace("_", "-") not in packages:
                    raise QueryError(f"failed to parse query {query!r}: no crate named {p.name}")
                named.append((i, packages[p.name.replace("_", "-")][0], p.requirement))
    out = spark.createDataFrame([], PREDICATES)
    if named:
        distinct = sorted({r for *_, r in named if r is not None}, key=str)
        rows = spark.createDataFrame([(i, c, None if r is None else distinct.index(r)) for i, c, r in named], "query_id int, crate_id long, n int")
        req = reduce(lambda case, n: case.when(F.col("n") == n, semver.requirement_literal(distinct[n])), range(len(distinct)), F.when(F.lit(False), semver.requirement_literal(None)))
        out = out.unionByName(rows.select("query_id", "crate_id", req.cast(semver.REQUIREMENT).alias("req")))
    if owning:
        rows = spark.createDataFrame(owning, "query_id int, kind string, owner_id long").join(registry.owned, ["kind", "owner_id"])
        out = out.unionByName(rows.select("query_id", "crate_id", semver.requirement_literal(None).alias("req")))
    return out


def labels(registry: Registry, queries: Iterable[str]) -> list[str]:
    """The queries with canonical names and requirements, predicates joined by ``or``."""
    parsed = [parse(q) for q in queries]
    packages, owners = _look_up(registry, parsed)
    out = []
    for predicates in parsed:
        parts = []
        for p in predicates:
            if isinstance(p, Owner):
                parts.append("@" + owners[p.name.lower()][2])
            else:
                name = packages[p.name.replace("_", "-")][1]
                parts.append(name if p.requirement is None else f"{name}:{semver.requirement_label(p.requirement)}")
        out.append(" or ".join(parts))
    return out

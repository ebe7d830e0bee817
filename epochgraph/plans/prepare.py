"""What is done to a registry before queries: packages left out, and requirements that are too wide narrowed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semver
from ..operators.temporal import clipped, fill_forward
from ..sources.schema import Registry
from ..sources.shared import stored


def exclude(registry: Registry, patterns: Sequence[str]) -> Registry:
    """Without the releases of packages whose name any pattern is found in; they vanish from counts and totals alike."""
    if not patterns:
        return registry
    out = F.lit(False)
    for p in patterns:
        out = out | F.col("name").rlike(p)
    gone = registry.packages.filter(out).select("crate_id")
    return replace(registry, releases=registry.releases.join(gone, "crate_id", "left_anti").select(registry.releases.columns))


def pattern_error(spark: SparkSession, pattern: str) -> str | None:
    """What is wrong with a pattern, in the dialect that runs it; None if nothing is."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError as e:
        return str(e.java_exception.getMessage()).splitlines()[0]
    return None


def asked_at(registry: Registry, dates: Sequence[str]) -> Registry:
    """The registry as far as answers at some dates depend on it, to be used after ``clamp``, which judges by the true times.

    Releases after the last date go, their dependencies with them, and each other one counts from the first date that isn't before it;
    ``published_at`` keeps its time. Every later step then sees at most as many instants as there are dates.
    """
    releases = clipped(registry.releases.withColumn("published_at", F.col("created_at")), "created_at", dates)
    dependencies = registry.dependencies.join(releases.select("version_id"), "version_id", "left_semi").select(registry.dependencies.columns)
    return replace(registry, releases=releases, dependencies=dependencies)


def clamp(registry: Registry) -> Registry:
    """Requirements that would take any future version are narrowed to what was compatible when their release came out.

    Judged once for each dependency, against the greatest version of its target published by then, its own release included; a place
    in the order of publication is (created_at, load_ord). Dependencies of releases that are gone, or on packages without any release
    by then, stay as they are.

    Most requirements can't be too wide at any time, which their ranges tell; only the dependencies with others are looked at, and all
    others go on as they were read. These few are filled forward together with the publications, each at its release's place. The verdict
    needs a version's three numbers alone.
    """
    columns, releases = registry.dependencies.columns, registry.releases
    key = semver.version_key(*(F.col("ver")[n] for n in ("major", "minor", "patch")))
    places = releases.select("version_id", "created_at", "load_ord")
    dependencies = stored(registry.dependencies)
    doubtful = F.coalesce(F.col("may_widen"), F.lit(False))
    asked = dependencies.filter(doubtful)
    texts = asked.select("req_key", "req", "low", "high").distinct().dropDuplicates(["req_key"])  # met again when all is filled: they are wide, and few
    rows = asked.drop("req", "low", "high").join(places, "version_id", "left").withColumns({"asks": F.lit(True), "top": F.lit(None).cast("string")})
    offered = releases.select("crate_id", "created_at", "load_ord", F.lit(False).alias("asks"), key.alias("top"))
    rows = stored(rows.unionByName(offered, allowMissingColumns=True))
    gone = F.col("asks") & F.col("created_at").isNull()
    known = fill_forward(rows.filter(~gone), ["crate_id"], "created_at", ["created_at", "load_ord"], "top").filter("asks").join(texts, "req_key")
    numbers = semver.numbers_of_key(F.col("top"))
    following = semver.next_incompatible(F.struct(*(n.alias(name) for n, name in zip(numbers, ("major", "minor", "patch"), strict=True))))
    known = known.withColumn("_next", semver.version_key(*(following[n] for n in ("major", "minor", "patch"))))
    too_wide = F.coalesce(F.col("top").isNotNull() & (F.col("low") <= F.col("_next")) & (F.col("_next") < F.col("high")), F.lit(False))
    caret = F.array(semver.comparator(F.lit("caret"), *numbers)).cast(semver.REQUIREMENT)
    narrow = {"req": caret, "req_key": semver.caret_text(*numbers), "low": F.col("top"), "high": F.col("_next"), "may_pre": F.lit(False), "may_widen": F.lit(False)}
    narrowed = known.withColumn("_w", too_wide).withColumns({name: F.when(F.col("_w"), value).otherwise(F.col(name)) for name, value in narrow.items()})
    rest = dependencies.filter(~doubtful).select(columns).unionByName(rows.filter(gone).join(texts, "req_key").select(columns))
    return replace(registry, dependencies=rest.unionByName(narrowed.select(columns)))

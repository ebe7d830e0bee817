"""Steps that cost more than their share as tables grow: passes over ids, what is kept between steps, and rows of one task."""

import re
import subprocess

import pytest
from pyspark.sql import functions as F

from epochgraph.plans import queries
from epochgraph.sources import dump, shared, star
from epochgraph.sources.repair import mend
from support import SF


def jobs(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize(("free", "first"), [((70_001, 70_002, 90_000), 1), ((), 0), ((64, 127, 128, 99_999), 3)])
def test_unused_ids_take_few_passes(spark, free, first):
    """The least ids, in as many jobs whether the first gap comes after ten ids or a hundred thousand."""
    df = spark.range(100_000).filter(~F.col("id").isin(*free)) if free else spark.range(100_000)
    want = [i for i in range(first, 100_200) if i in free or i >= 100_000][:100]
    found, n = jobs(spark, f"unused-{first}", lambda: mend._unused(df, "id", first, 100))
    assert found == want and n <= 8


def test_unused_ids_between_and_before(spark):
    df = spark.createDataFrame([(i,) for i in [*range(0, 5000), 5002, *range(6000, 6100), 10**12, -5]], "id long")
    assert mend._unused(df, "id", 0, 3) == [5000, 5001, 5003]
    assert mend._unused(df, "id", 7000, 200) == list(range(7000, 7200))
    assert mend._unused(spark.range(0), "id", 1, 5) == [1, 2, 3, 4, 5]


def test_requirements_are_read_without_dependencies(spark):
    plan = queries.requirement_order(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "l_orderkey" not in plan
    want = {r[0] for r in star.dependencies(spark, SF).select("req_key").distinct().collect()}
    assert {r[0] for r in star.requirements(spark, SF).select("req_key").collect()} == want


def test_pairs_are_not_parsed(spark):
    """What is read from a version's text is read before it meets the requirements."""
    plan = queries.semver_matching_all(spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join" in line)
    assert not any("regexp" in line.lower() or "rlike" in line.lower() for line in plan[:join])


def test_stored_tables_are_compressed(spark):
    rows = spark.range(50_000).select("id", F.lit("a requirement that most rows share").alias("text"), F.array(F.struct(F.lit(1).alias("a"))).alias("list"))
    kept = shared.stored(rows)
    assert kept.schema.simpleString() == rows.schema.simpleString() and kept.exceptAll(rows).isEmpty() and kept.count() == 50_000
    folder = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    size = int(subprocess.run(["du", "-sk", folder], capture_output=True, text=True, check=True).stdout.split()[0])
    assert size < 800  # KB; some 5,000 as rows


def test_tasks_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS_A_TASK", 500)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert shared.parts_for(spark.range(100)) == 4 and shared.parts_for(spark.range(100_001)) == 201
    deps = star.dependencies(spark, SF)
    assert "hashpartitioning(l_orderkey#" in deps._jdf.queryExecution().toString() and f", {-(-lines // 500)})" in deps._jdf.queryExecution().toString()
    assert deps.count() == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey", "l_linenumber", F.floor("l_quantity"), "l_returnflag", "l_linestatus", F.col("l_tax") >= 0.04, F.col("l_discount") < 0.05, F.col("l_discount") >= 0.08).distinct().count()


ITEMS = '{"b":["x","p-2/f","p_2?/g","al/h","/own","?/w","a/b/c"],"a":[],"n":null,"m":[null,"q"]}'


def releases_with_features(spark):
    rows = [(1, 1, "1.0.0", ITEMS), (2, 2, "1.0.0", "{}"), (3, 2, "1.0.0", None), (4, 2, "1.0.0", "bad"), (5, 9, "0.1.0", '{"t":["test-server/x"]}'), (7, 2, "1.0.0", '{"z":["al/q","gone/r"]}')]
    versions = spark.createDataFrame(rows, "id long, crate_id long, num string, features string")
    renamed = spark.createDataFrame([(1, 1, 3, "al"), (2, 1, 2, "al"), (3, 7, 3, "al"), (4, 7, None, "gone"), (5, 1, 1, None)], "id long, version_id long, crate_id long, explicit_name string")
    packages = spark.createDataFrame([(1, "p1"), (2, "p_2"), (3, "p3"), (4, "a"), (9, "modbus"), (10, "gone")], "crate_id long, name string")
    return dump.features_of(versions, renamed, packages)


def test_features_of_odd_items(spark):
    found = {r["version_id"]: [(f["feature"], [tuple(e) for e in f["enables"]], [tuple(e) for e in f["weak_enables"]]) for f in r["features"]] for r in releases_with_features(spark).collect()}
    b = ("b", [(1, "x"), (2, "f"), (2, "h"), (1, "own"), (4, "b/c")], [(2, "g"), (1, "w")])
    assert found == {1: [("a", [], []), b, ("m", [(1, "q")], []), ("n", [], [])], 5: [("t", [(9, "x")], [])], 7: [("z", [(3, "q"), (10, "r")], [])]}


def test_features_travel_by_release(spark):
    """With tables too large to broadcast, only names that are asked for go to the packages, and no own feature does; the rest is dealt by release."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = releases_with_features(spark)
        plan = found._jdf.queryExecution().executedPlan().toString()
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
        assert dealt and all(re.match(r"(version_id|id|_key)#\d+L?, \d+$", d) for d in dealt), dealt
        assert sum(d.startswith("_key") for d in dealt) == 2
        assert found.count() == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_features_are_made_once(spark):
    """What a reader filters by isn't pushed below the making of the features."""
    made = releases_with_features(spark).filter(F.size("features") > 0).select("version_id", F.explode("features").alias("f"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "transform(" in line for line in plan.splitlines())

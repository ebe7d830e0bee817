"""Streams against the batch answer."""

import shutil

import pytest
from pyspark.sql import functions as F

from support import SF
from epochgraph.operators import graph
from epochgraph.sources import star
from epochgraph.streaming.running import LatestReleases, windowed_changes


def test_latest_releases(spark, tmp_path):
    releases = star.releases(spark, SF, features=False).select("version_id", "crate_id", "ver", "created_at")
    releases.repartitionByRange(3, "created_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(releases.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    latest = LatestReleases(spark, str(tmp_path / "out"))
    latest.start(stream).awaitTermination()
    changes = latest.changes()
    batches = len(list(tmp_path.glob("out/checkpoint/commits/[0-9]*")))  # one that moves nothing has no changes
    assert batches == len(list(tmp_path.glob("in/*.parquet"))) > 1
    now = {r["version_id"] for r in changes.groupBy("version_id").agg(F.sum("diff").alias("n")).filter("n > 0").collect()}
    assert now == {r["version_id"] for r in graph.recent(releases).filter("valid_to > '9999-01-01'").collect()}
    latest.fold(spark.read.parquet(str(tmp_path / "in")).limit(0), batches)
    assert latest.changes().filter(F.col("batch") == batches).count() == 0
    state = lambda n: {tuple(r) for r in spark.read.parquet(str(tmp_path / f"out/state/batch={n}")).select("crate_id", "rank.version_id").collect()}
    assert {v for _, v in state(batches)} == now and len(list(tmp_path.glob("out/state/batch=*"))) == 2
    latest.fold(releases.limit(1).withColumn("created_at", F.lit("2030-01-01").cast("timestamp")), batches + 1)
    assert len(state(batches + 1)) == len(state(batches)) and len(state(batches + 1) - state(batches)) <= 1
    shutil.rmtree(tmp_path / f"out/state/batch={batches + 1}")  # a lost state isn't passed over
    with pytest.raises(RuntimeError, match=f"batch {batches + 1} is missing"):
        latest.fold(releases, batches + 2)
    with pytest.raises(RuntimeError, match="missing"):
        LatestReleases(spark, str(tmp_path / "new")).fold(releases, 5)


def test_windowed_changes(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.lit(1).alias("diff"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed_changes(stream, ["event_type"]).writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windowed").agg(F.sum("diff")).first()[0] == events.count()
    assert {tuple(r) for r in spark.table("windowed").collect()} == {tuple(r) for r in windowed_changes(events, ["event_type"]).collect()}

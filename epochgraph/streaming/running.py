"""The changing parts as streams: which release is each package's latest, and counts from change logs.

Releases arrive as a stream; each micro-batch folds into one row of state for each package, kept as a Parquet table under a version
number that only grows, so that a batch that is run again gives the same result. A batch starts from the version of the batch right before
its own, and fails if that is lost; two versions are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class LatestReleases:
    """Folds a stream of releases (see ``sources.schema``) into the latest of each package, stable ones first.

    ``changes`` holds a row whenever a package's latest release changes: (batch, crate_id, version_id, created_at, diff).
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, batch: int | None = None):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state" + ("" if batch is None else f"/batch={batch}"))
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        """The batches whose state was written whole."""
        at, system = self._path()
        if not system.exists(at):
            return []
        found = [s.getPath() for s in system.listStatus(at)]
        done = [p for p in found if system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("batch=")) for p in done)

    def fold(self, releases: DataFrame, batch: int) -> None:
        rank = F.struct(F.col("ver.pre_empty").alias("stable"), "created_at", "version_id")
        fresh = releases.groupBy("crate_id").agg(F.max(rank).alias("rank"))
        versions = self._versions()
        earlier = [v for v in versions if v < batch]
        if batch and earlier[-1:] != [batch - 1]:  # every batch leaves a state, so a gap means that one was lost
            raise RuntimeError(f"batch {batch}: the state of batch {batch - 1} is missing")
        before = self.spark.read.parquet(f"{self.folder}/state/batch={earlier[-1]}") if earlier else fresh.limit(0)
        both = before.withColumnRenamed("rank", "old").join(fresh, "crate_id", "full_outer")
        folded = both.withColumn("new", F.when(F.col("old").isNull() | (F.col("rank") > F.col("old")), F.col("rank")).otherwise(F.col("old"))).persist()
        folded.select("crate_id", F.col("new").alias("rank")).write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")
        moved = folded.filter(F.col("old").isNull() | (F.col("old") != F.col("new")))
        steps = F.array(F.struct(F.col("old").alias("r"), F.lit(-1).alias("diff")), F.struct(F.col("new").alias("r"), F.lit(1).alias("diff")))
        rows = moved.select("crate_id", F.col("new.created_at").alias("created_at"), F.explode(steps).alias("s")).filter("s.r IS NOT NULL")
        rows.select("crate_id", F.col("s.r.version_id").alias("version_id"), "created_at", F.col("s.diff").alias("diff")).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch}")
        folded.unpersist()
        for version in earlier[:-1]:  # a batch that is run again needs the one before it
            at, system = self._path(version)
            system.delete(at, True)

    def start(self, stream: DataFrame, available_now: bool = True) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def changes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/changes")


def windowed_changes(changelog: DataFrame, keys: list[str], delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Net changes of each key by time window, for a streaming or static log (ts, diff); rows later than ``delay`` are dropped by a stream."""
    return changelog.withWatermark("ts", delay).groupBy(F.window("ts", width), *keys).agg(F.sum("diff").alias("diff")).select(F.col("window.start").alias("ts"), *keys, "diff")

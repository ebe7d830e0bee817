"""Each package's latest release, kept by the state of a stream, of a log that adds releases and takes them back.

A package's state is its releases and which of them is the latest, in Spark's own state store: a batch costs the packages that it
touches, the store's checkpoint makes a repeated batch give the same rows, and a lost version of it fails the stream. Needs the
RocksDB store, which ``start`` asks for, and Python's protobuf, which Spark's stateful processors in Python need.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"
#: A release's rank is (stable, created_at in microseconds, version_id): stable ones first, then later ones.
CHANGES = "crate_id long, version_id long, created long, diff long"


class Latest(StatefulProcessor):
    """A batch of one package's log to the changes of its latest release: the old one taken back, the new one added."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.releases = handle.getMapState("releases", "version_id long", "stable boolean, created long, n long")
        self.latest = handle.getValueState("latest", "stable boolean, created long, version_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.latest.get()) if self.latest.exists() else None
        best, searched = before, False
        for batch in rows:
            for version, stable, created, diff in zip(batch["version_id"].tolist(), batch["stable"].tolist(), batch["created"].tolist(), batch["diff"].tolist(), strict=True):
                known = self.releases.getValue((version,)) if self.releases.containsKey((version,)) else (stable, created, 0)
                n = known[2] + diff
                if n:
                    self.releases.updateValue((version,), (known[0], known[1], n))
                else:
                    self.releases.removeKey((version,))
                rank = (known[0], known[1], version)
                if n > 0:
                    best = rank if best is None else max(best, rank)
                elif rank == best:  # which is the next one is searched when all rows are in
                    searched = True
        if searched:
            there = ((value[0], value[1], version[0]) for version, value in self.releases.iterator() if value[2] > 0)
            best = max(there, default=None)
        if best == before:
            return
        if best is None:
            self.latest.clear()
        else:
            self.latest.update(best)
        moved = [(key[0], r[2], r[1], d) for r, d in ((before, -1), (best, 1)) if r is not None]
        yield pd.DataFrame(moved, columns=["crate_id", "version_id", "created", "diff"])

    def close(self) -> None:
        pass


def latest_changes(log: DataFrame) -> DataFrame:
    """(crate_id, version_id, created_at, diff) whenever a package's latest release changes, of a stream of releases.

    ``log`` holds (crate_id, version_id, stable, created_at, diff): diff adds a release that many times or takes it back; it is there
    while the sum is above zero, also if what takes it back comes first. Rows with a null package, release, time or diff are dropped,
    a null ``stable`` is false. Within a batch only the outcome counts. A release that is known keeps its first rank until it is gone.
    """
    rows = log.select(F.col("crate_id").cast("long").alias("crate_id"), F.col("version_id").cast("long").alias("version_id"), F.coalesce("stable", F.lit(False)).alias("stable"), F.unix_micros("created_at").alias("created"), F.col("diff").cast("long").alias("diff"))
    rows = rows.dropna()
    found = rows.groupBy("crate_id").transformWithStateInPandas(Latest(), CHANGES, "append", "none")
    return found.select("crate_id", "version_id", F.timestamp_micros("created").alias("created_at"), "diff")


def start(log: DataFrame, folder: str, available_now: bool = True) -> StreamingQuery:
    """Run ``latest_changes`` into Parquet at ``folder``/changes, each row once however often a batch is run."""
    conf = log.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, PROVIDER)  # a query takes its session's settings along when it starts
    try:
        writer = latest_changes(log).writeStream.format("parquet").outputMode("append").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(STORE, before)


def latest_of(changes: DataFrame) -> DataFrame:
    """(crate_id, version_id) of what the changes add up to."""
    return changes.groupBy("crate_id", "version_id").agg(F.sum("diff").alias("n")).filter("n > 0").select("crate_id", "version_id")

"""The folder that driver and executors share, and what is kept in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows (some 100 to 200 bytes each in memory) of a table that one task makes distinct.
ROWS_A_TASK = 400_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; in local mode, where none is named, one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder, so that loops neither grow plans nor depend on one executor."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same cut for tables as large as the input, as Parquet: compressed by column, and later reads take only the columns that they need.

    Rows come back in any order and number of partitions.
    """
    folder = f"{_checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def parts_for(table: DataFrame) -> int:
    """How many tasks work on a table's rows, or on a few rows for each of them, so that none gets more than ``ROWS_A_TASK``, whatever its size.

    The rows of stored and Parquet tables are counted from the files' footers.
    """
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-table.count() // ROWS_A_TASK))


def _checkpoint_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    return sc._jsc.sc().getCheckpointDir().get()

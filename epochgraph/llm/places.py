"""Gapless places in order, however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed


def placed(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order of ``order`` (null first) inside ``groups``, and ``total``, the rows of the group.

    Rows are dealt by range of (groups, order) and sorted there, so a group of any size is cut into as many tasks as it needs; places
    follow from the counts of the runs that a group has in each partition, a table of at most partitions + groups rows. Null keys are
    a group. Rows that tie in ``order`` stand in any order. No rows give no rows. ``place`` and ``total`` replace columns of these
    names. The result is checkpointed.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.drop("place", "total").repartitionByRange(parts, *groups, *order).sortWithinPartitions(*groups, *order)
    dealt = checkpointed(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    runs = dealt.groupBy(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*(f"_g{i}" for i in range(len(groups))))
    before = F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("total", F.sum("_n").over(group)).withColumn("_before", F.coalesce(before, F.lit(0)) - F.col("_first")).drop("_first", "_n")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    both = dealt.join(runs, [*same, part == F.col("_part")])
    return both.select(*rows.drop("place", "total").columns, (F.col("_at") + F.col("_before")).alias("place"), "total")

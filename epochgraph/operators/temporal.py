"""Algebra of rows with validity intervals [valid_from, valid_to), and of change logs (ts, diff).

An answer at a time depends only on what holds at that time, so joins meet intervals and counts add changes; nothing is ever
evaluated instant by instant. The open end is a far timestamp.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPOCH, FOREVER = "1970-01-01 00:00:00", "9999-12-31 00:00:00"
FROM, TO = "valid_from", "valid_to"


def epoch() -> Column:
    return F.lit(EPOCH).cast("timestamp")


def forever() -> Column:
    return F.lit(FOREVER).cast("timestamp")


def since(df: DataFrame, ts: Column | str) -> DataFrame:
    """Rows that hold from ``ts`` on."""
    return df.withColumn(FROM, F.col(ts) if isinstance(ts, str) else ts).withColumn(TO, forever())


def interval_join(left: DataFrame, right: DataFrame, on: list[str], condition: Column | None = None) -> DataFrame:
    """Inner join on equal keys while both rows hold; the result holds while both do.

    Columns other than the keys and the interval must have different names. Null keys meet nothing.
    """
    a = left.withColumnRenamed(FROM, "_from").withColumnRenamed(TO, "_to")
    both = a.join(right, on).filter((F.col("_from") < F.col(TO)) & (F.col(FROM) < F.col("_to")))
    if condition is not None:
        both = both.filter(condition)
    return both.withColumn(FROM, F.greatest("_from", FROM)).withColumn(TO, F.least("_to", TO)).drop("_from", "_to")


def running_max_intervals(df: DataFrame, keys: list[str], value: str, ts: str) -> DataFrame:
    """(keys, value, interval): while each value is the greatest seen so far of its keys.

    Values at one instant count together. The window runs over one key's distinct instants only.
    """
    at = df.groupBy(*keys, F.col(ts).alias(FROM)).agg(F.max(value).alias(value))
    order = Window.partitionBy(*keys).orderBy(FROM)
    best = at.withColumn(value, F.max(value).over(order)).withColumn("_last", F.lag(value).over(order))
    return best.filter(~F.col("_last").eqNullSafe(F.col(value))).drop("_last").withColumn(TO, F.lead(FROM, 1).over(order)).withColumn(TO, F.coalesce(TO, forever()))


def changes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ts, diff): +1 where a row begins, -1 where it ends, added up; no row where they cancel or for the open end."""
    steps = F.array(F.struct(F.col(FROM).alias("ts"), F.lit(1).alias("diff")), F.struct(F.col(TO).alias("ts"), F.lit(-1).alias("diff")))
    flat = df.select(*keys, F.explode(steps).alias("_s")).select(*keys, "_s.ts", "_s.diff")
    return consolidate(flat.filter(F.col("ts") < forever()), [*keys, "ts"])


def consolidate(df: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of equal rows added up; those that cancel go."""
    return df.groupBy(*keys).agg(F.sum("diff").cast("long").alias("diff")).filter("diff <> 0")


def coalesce_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """The union of each key's intervals as its fewest disjoint ones: distinct, at every time."""
    order = Window.partitionBy(*keys).orderBy("ts")
    cover = changes(df, keys).withColumn("_n", F.sum("diff").over(order))
    edges = cover.withColumn("_before", F.col("_n") - F.col("diff")).filter("(_n = 0) <> (_before = 0)")
    spans = edges.withColumn(TO, F.coalesce(F.lead("ts", 1).over(order), forever()))
    return spans.filter("_n > 0").select(*keys, F.col("ts").alias(FROM), TO)


def subtract_intervals(df: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """When ``df`` holds and ``taken`` doesn't, for each key."""
    order = Window.partitionBy(*keys).orderBy("ts")
    flat = df.select(*keys, FROM, TO, F.lit(True).alias("_own")).unionByName(taken.select(*keys, FROM, TO, F.lit(False).alias("_own")))
    steps = F.array(F.struct(F.col(FROM).alias("ts"), F.lit(1).alias("diff")), F.struct(F.col(TO).alias("ts"), F.lit(-1).alias("diff")))
    flat = flat.repartition(*keys)  # one shuffle for the sums and the windows
    both = flat.select(*keys, "_own", F.explode(steps).alias("_s")).groupBy(*keys, F.col("_s.ts").alias("ts"))
    both = both.agg(F.sum(F.when(F.col("_own"), F.col("_s.diff")).otherwise(0)).alias("_a"), F.sum(F.when(F.col("_own"), 0).otherwise(F.col("_s.diff"))).alias("_b"))
    cover = both.withColumn("_here", (F.sum("_a").over(order) > 0) & (F.sum("_b").over(order) == 0))
    edges = cover.withColumn("_was", F.coalesce(F.lag("_here").over(order), F.lit(False))).filter("_here <> _was")
    return edges.withColumn(TO, F.lead("ts", 1).over(order)).filter("_here").select(*keys, F.col("ts").alias(FROM), TO)


def spans_by_days(steps: DataFrame, keys: list[str], diffs: list[str], holds: Callable[..., Column]) -> DataFrame:
    """(keys, interval): while ``holds`` of the running sums of ``diffs`` is true, for keys that may hold a large share of all rows.

    ``steps`` has one row for each key and ``ts``; ``holds`` takes a column for each sum and is false of zeros. A day's edges are found
    in the day; days hand on their sums and where the next day's first edge is. So no task orders more than a key's days or one of
    its days. Costs two joins more than one window a key.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    by_day = [*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), F.to_date("ts").alias("_d")]
    from_day_to_day = Window.partitionBy(*own).orderBy("_d")
    earlier = from_day_to_day.rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_day").orderBy("ts")
    days = steps.groupBy(*by_day).agg(*(F.sum(d).alias(f"_before_{d}") for d in diffs))
    days = days.select(*own, "_d", *(F.coalesce(F.sum(f"_before_{d}").over(earlier), F.lit(0)).alias(f"_before_{d}") for d in diffs))
    same = [*(F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)), F.col("_day") == F.col("_d")]
    sums = steps.withColumn("_day", F.to_date("ts")).withColumns({f"_in_{d}": F.sum(d).over(inside) for d in diffs}).join(days, same)
    now = [F.col(f"_in_{d}") + F.col(f"_before_{d}") for d in diffs]
    just_before = [n - F.col(d) for n, d in zip(now, diffs, strict=True)]
    edges = sums.withColumn("_begins", holds(*now)).filter(F.col("_begins") != holds(*just_before)).select(*keys, "_day", "ts", "_begins")
    within = edges.withColumn(TO, F.lead("ts", 1).over(inside)).filter(F.col("_begins") & F.col(TO).isNotNull())
    last = edges.groupBy(*by_day).agg(F.min("ts").alias("_first"), F.max(F.struct("ts", "_begins")).alias("_last"))
    last = last.withColumn(TO, F.coalesce(F.lead("_first", 1).over(from_day_to_day), forever())).filter("_last._begins")
    beyond = last.select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), F.col("_last.ts").alias(FROM), TO)
    return within.select(*keys, F.col("ts").alias(FROM), TO).unionByName(beyond)


def coalesce_by_days(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same as ``coalesce_intervals``, for keys of any size."""
    return spans_by_days(changes(df, keys), keys, ["diff"], lambda n: n > 0)


def subtract_by_days(df: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """The same as ``subtract_intervals``, for keys of any size."""
    own, other = (changes(d, keys).withColumn(name, F.col("diff")) for d, name in ((df, "_own"), (taken, "_taken")))
    both = own.unionByName(other, allowMissingColumns=True).groupBy(*keys, "ts").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_own", "_taken")))
    return spans_by_days(both, keys, ["_own", "_taken"], lambda a, b: (a > 0) & (b == 0))


def as_of(df: DataFrame, ts: Column) -> DataFrame:
    """The rows that hold at one instant."""
    return df.filter((F.col(FROM) <= ts) & (ts < F.col(TO)))


def at_dates(df: DataFrame, dates: Sequence[str]) -> DataFrame:
    """The rows that hold at each of some dates, with the date as ``as_of``."""
    each = df.withColumn("as_of", F.explode(F.array(*(F.lit(d).cast("timestamp") for d in dates))))
    return as_of(each, F.col("as_of"))


def clipped(rows: DataFrame, ts: str, dates: Sequence[str]) -> DataFrame:
    """``rows`` with each time moved to the first of some dates that isn't before it; rows after the last date go.

    What holds at a date depends on what came until then, so an answer asked at these dates alone stays the same, while windows and
    joins see as many instants as there are dates. Filtered where the rows are read, so the scan skips what is later.
    """
    steps = sorted(dates)
    moved = F.lit(steps[-1]).cast("timestamp")
    for d in reversed(steps[:-1]):
        moved = F.when(F.col(ts) <= F.lit(d).cast("timestamp"), F.lit(d).cast("timestamp")).otherwise(moved)
    return rows.filter(F.col(ts) <= F.lit(steps[-1]).cast("timestamp")).withColumn(ts, moved)


def fill_forward(rows: DataFrame, keys: list[str], ts: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` replaced by the greatest one of its keys up to its place, its own included; null where there is none yet.

    A place is ``order``, of which ``ts`` is the first part; rows of one place count together. Values are carried in two levels, from
    day to day and inside a day, so no task orders more than a key's days or one of its days, and all joins are by equality. ``rows`` are
    read twice.
    """
    day = F.to_date(ts)
    days = rows.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), day.alias("_d")).agg(F.max(value).alias("_before"))
    earlier = Window.partitionBy(*(f"_k{i}" for i in range(len(keys)))).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.max("_before").over(earlier))
    inside = Window.partitionBy(*keys, "_day").orderBy(*order)
    rows = rows.withColumn("_day", day).withColumn(value, F.max(value).over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = rows.join(days, [*same, F.col("_day") == F.col("_d")])
    return both.withColumn(value, F.greatest(value, "_before")).drop("_day", "_d", "_before", *(f"_k{i}" for i in range(len(keys))))

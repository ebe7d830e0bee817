"""Step-function time series from change logs: totals, dense rows, fractions, and the points of a chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import changes, coalesce_intervals, consolidate


def cumulative(df: DataFrame, keys: list[str], ts: str, value: str, out: str) -> DataFrame:
    """The running sum of ``value`` by time for each key, ties in time summed together.

    In two levels, over days and inside a day, so that no task orders more than a key's days or one of its days.
    """
    at = df.groupBy(*keys, ts).agg(F.sum(value).alias("_v")).withColumn("_day", F.to_date(ts))
    days = at.groupBy(*keys, "_day").agg(F.sum("_v").alias("_d"))
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_before", F.coalesce(F.sum("_d").over(earlier), F.lit(0))).drop("_d")
    inside = Window.partitionBy(*keys, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_day").alias("_d"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    both = at.withColumn("_in", F.sum("_v").over(inside)).join(days, [*same, F.col("_day") == F.col("_d")])
    return both.select(*keys, ts, (F.col("_in") + F.col("_before")).cast("long").alias(out))


def count_changes(results: DataFrame) -> DataFrame:
    """(query_id, ts, diff) from intervals of (version_id, query_id): each counts once at any time, however often it is there."""
    distinct = coalesce_intervals(results, ["version_id", "query_id"])
    return consolidate(changes(distinct, ["version_id", "query_id"]), ["query_id", "ts"])


def integrate(changelog: DataFrame, query_ids: list[int]) -> DataFrame:
    """(ts, query_id, value): a row for every query at every time at which any of them changes."""
    times = changelog.select("ts").distinct().withColumn("query_id", F.explode(F.array(*map(F.lit, query_ids)).cast("array<int>")))
    dense = times.join(changelog, ["ts", "query_id"], "left").withColumn("diff", F.coalesce("diff", F.lit(0)))
    return cumulative(dense, ["query_id"], "ts", "diff", "value").select("ts", "query_id", "value")


def totals(releases: DataFrame) -> DataFrame:
    """(ts, total): packages with a first release up to each such time."""
    first = releases.groupBy("crate_id").agg(F.min("created_at").alias("ts")).groupBy("ts").agg(F.count("*").alias("n"))
    return cumulative(first.withColumn("_all", F.lit(0)), ["_all"], "ts", "n", "total").drop("_all")


def relative(series: DataFrame, releases: DataFrame) -> DataFrame:
    """The series with ``total``, the packages that existed at each time, and the ``fraction`` of them, a float."""
    first = releases.groupBy("crate_id").agg(F.min("created_at").alias("ts")).groupBy("ts").agg(F.count("*").alias("n"))
    probes = series.select("ts").distinct().withColumn("n", F.lit(0).cast("long"))
    at = cumulative(first.unionByName(probes).withColumn("_all", F.lit(0)), ["_all"], "ts", "n", "total").drop("_all")
    return series.join(at, "ts").withColumn("fraction", fraction(F.col("value"), F.col("total")))


def fraction(value: Column, total: Column) -> Column:
    return (value.cast("float") / total.cast("float")).cast("float")


def wide(series: DataFrame, query_ids: list[int], value: str = "value") -> DataFrame:
    """(ts, values array) in the queries' order."""
    found = series.groupBy("ts").agg(*(F.max(F.when(F.col("query_id") == q, F.col(value))).alias(f"_q{q}") for q in query_ids))
    return found.select("ts", F.array(*(F.col(f"_q{q}") for q in query_ids)).alias("values"))


def chart_points(series: DataFrame, now: Column) -> DataFrame:
    """(query_id, ts, value) as a chart draws them.

    Leading zeros and repeats go. A zero stands right before the first value: a second earlier, or at the second's start if
    the time isn't whole. The last value is drawn again at ``now``.

    Each day is summed up by its last and its greatest value, and days hand these on, so that a task orders a query's days or one of
    its days, never all of its times.
    """
    rows = series.select("query_id", "ts", "value", F.to_date("ts").alias("_day"))
    days = rows.groupBy("query_id", "_day").agg(F.max_by("value", "ts").alias("_was"), F.max("value").alias("_top"))
    order = Window.partitionBy("query_id").orderBy("_day")
    days = days.select("query_id", "_day", F.lag("_was").over(order).alias("_was"), F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_top"))
    inside = Window.partitionBy("query_id", "_day").orderBy("ts")
    seen = rows.join(days, ["query_id", "_day"]).withColumns({
        "_last": F.coalesce(F.lag("value").over(inside), "_was"),
        "_before": F.greatest(F.max("value").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_top"), F.lit(0)),
    })
    points = seen.withColumn("_first", (F.col("_before") <= 0) & (F.col("value") > 0)).filter("_first OR _before > 0 AND _last <> value")
    whole = F.date_trunc("second", "ts")
    start = points.filter("_first").select("query_id", F.greatest(F.when(whole == F.col("ts"), F.col("ts") - F.expr("INTERVAL 1 SECOND")).otherwise(whole), F.lit("1970-01-01 00:00:00").cast("timestamp")).alias("ts"), F.lit(0).cast("long").alias("value"))
    last = series.groupBy("query_id").agg(F.max(F.struct("ts", "value")).alias("l")).filter(F.col("l.ts") < now).select("query_id", now.alias("ts"), F.col("l.value").alias("value"))
    return start.unionByName(points.select("query_id", "ts", "value")).unionByName(last)


def thinned(points: DataFrame, most: int, spans: int) -> DataFrame:
    """(query_id, ms, shown) of which series with more than ``most`` points keep, in each of ``spans`` equal spans of time, the first, least, greatest and last one.

    No peak and no drop is lost. All in aggregates; ties in value keep the earliest least and the latest greatest point.
    """
    whole = points.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("ms").alias("_from"), F.max("ms").alias("_to"))
    rows = points.join(whole, "query_id")
    few = rows.filter(F.col("_n") <= most).select("query_id", "ms", "shown")
    span = F.expr(f"(ms - _from) * {spans} div (_to - _from + 1)")
    by_time, by_value = F.struct("ms", "shown"), F.struct("shown", "ms")
    each = rows.filter(F.col("_n") > most).groupBy("query_id", span.alias("_span")).agg(F.min(by_time).alias("a"), F.max(by_time).alias("b"), F.min(by_value).alias("c"), F.max(by_value).alias("d"))
    kept = F.array_distinct(F.array(*(F.struct(F.col(c)["ms"].alias("ms"), F.col(c)["shown"].alias("shown")) for c in "abcd")))
    return few.unionByName(each.select("query_id", F.explode(kept).alias("p")).select("query_id", "p.ms", "p.shown"))


def chart_value(value: Column, total: Column | None) -> Column:
    """What a chart shows for a value: itself, or its share of the total; an empty total is 0 and a share of all is drawn as a half."""
    if total is None:
        return value.cast("double")
    return F.when(total == 0, F.lit(0.0)).when(value == total, F.lit(0.5)).otherwise(fraction(value, total).cast("double"))


def extents(points: DataFrame) -> DataFrame:
    """(first, last, greatest): what a chart's axes must span."""
    return points.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.max("value").alias("greatest"))

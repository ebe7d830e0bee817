"""Interval algebra against evaluation at every instant."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from epochgraph.operators import series, temporal

T0, DAYS = datetime(2020, 1, 1), 12
OPEN = datetime(9999, 12, 31)


def day(i):
    return OPEN if i is None else T0 + timedelta(days=i)


def rows(seed, n=60, keys=4):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        a = rnd.randrange(DAYS)
        out.append((rnd.randrange(keys), a, rnd.choice([None, *range(a + 1, DAYS + 1)])))
    return out


def frame(spark, data, key="k"):
    return spark.createDataFrame([(k, day(a), day(b)) for k, a, b in data], f"{key} int, valid_from timestamp, valid_to timestamp")


def holds(data, key, i):
    return any(k == key and a <= i and (b is None or i < b) for k, a, b in data)


def covered(df, key="k"):
    found = {}
    for r in df.collect():
        for i in range(DAYS + 2):
            if r["valid_from"] <= day(i) < r["valid_to"]:
                assert (r[key], i) not in found, "intervals overlap"
                found[r[key], i] = True
    return set(found)


@pytest.mark.parametrize("seed", range(3))
def test_coalesce_and_subtract(spark, seed):
    a, b = rows(seed), rows(seed + 100, 25)
    merged = temporal.coalesce_intervals(frame(spark, a), ["k"])
    assert covered(merged) == {(k, i) for k in range(4) for i in range(DAYS + 2) if holds(a, k, i)}
    spans = sorted((r["k"], r["valid_from"], r["valid_to"]) for r in merged.collect())
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(spans, spans[1:], strict=False)), "adjacent intervals stay apart"
    rest = temporal.subtract_intervals(frame(spark, a), frame(spark, b), ["k"])
    assert covered(rest) == {(k, i) for k in range(4) for i in range(DAYS + 2) if holds(a, k, i) and not holds(b, k, i)}


def whole(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", range(2))
def test_by_days(spark, seed):
    """The forms for hot keys against the plain ones: edges inside days and days apart, null keys, a key with most rows."""
    rnd = random.Random(seed)

    def made(n):
        out = []
        for _ in range(n):
            a = T0 + timedelta(hours=rnd.randrange(24 * DAYS))
            b = OPEN if rnd.random() < 0.02 else a + timedelta(hours=rnd.choice([0, 1, 1, 2, 5, 30, 70]))
            out.append((rnd.choice([0] * 4 + [1, 2, 3, None]), rnd.choice(["x", "x", None]), a, b))
        return spark.createDataFrame(out, "k int, l string, valid_from timestamp, valid_to timestamp")

    a, b = made(90), made(60)
    keys = ["k", "l"]
    merged = whole(temporal.coalesce_by_days(a, keys))
    assert merged == whole(temporal.coalesce_intervals(a, keys)) and len(merged) > 15
    rest = whole(temporal.subtract_by_days(a, b, keys))
    assert rest == whole(temporal.subtract_intervals(a, b, keys)) and len(rest) > 15
    assert any(r[2].date() == r[3].date() for r in merged) and any(r[3] == OPEN for r in merged)
    assert whole(temporal.coalesce_by_days(a.limit(0), keys)) == []
    assert whole(temporal.subtract_by_days(a, b.limit(0), keys)) == merged and whole(temporal.subtract_by_days(b.limit(0), a, keys)) == []


def test_hot_keys_are_ordered_by_day(spark):
    """No window of the plan orders a key's edges at once: each is over a day, or over days' sums."""
    rows = spark.createDataFrame([(1, T0, T0 + timedelta(hours=1))], "k int, valid_from timestamp, valid_to timestamp")
    plan = temporal.coalesce_by_days(rows, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "+- Window [" in line]
    assert len(windows) >= 4 and all("_day" in w or "_d#" in w for w in windows)


def test_join(spark):
    a, b = rows(1), rows(2)
    got = temporal.interval_join(frame(spark, a), frame(spark, b), ["k"])
    want = sorted((k, day(max(x, p)), min(day(y), day(q))) for k, x, y in a for j, p, q in b if k == j and max(x, p) < min(y or 99, q or 99))
    assert sorted((r["k"], r["valid_from"], r["valid_to"]) for r in got.collect()) == want


def test_running_max_with_ties(spark):
    data = [(1, day(0), 5), (1, day(0), 7), (1, day(1), 6), (1, day(2), 7), (1, day(3), 9), (2, day(1), 1), (None, day(4), 3)]
    got = temporal.running_max_intervals(spark.createDataFrame(data, "k int, ts timestamp, v int"), ["k"], "v", "ts")
    assert {(r["k"], r["v"], r["valid_from"], r["valid_to"]) for r in got.collect()} == {(1, 7, day(0), day(3)), (1, 9, day(3), OPEN), (2, 1, day(1), OPEN), (None, 3, day(4), OPEN)}


def test_counts_are_dense_and_distinct(spark):
    data = [(1, 0, day(0), day(3)), (1, 0, day(1), day(5)), (2, 0, day(2), OPEN), (2, 1, day(2), day(4))]
    df = spark.createDataFrame(data, "version_id int, query_id int, valid_from timestamp, valid_to timestamp")
    got = series.integrate(series.count_changes(df), [0, 1, 2])
    table = {(r["ts"], r["query_id"]): r["value"] for r in got.collect()}
    assert table == {(day(i), q): v for i, values in ((0, (1, 0, 0)), (2, (2, 1, 0)), (4, (2, 0, 0)), (5, (1, 0, 0))) for q, v in enumerate(values)}
    wide = series.wide(got, [0, 1, 2]).orderBy("ts").collect()
    assert [r["values"] for r in wide] == [[1, 0, 0], [2, 1, 0], [2, 0, 0], [1, 0, 0]]


def test_cumulative_over_days(spark):
    rnd = random.Random(4)
    data = [(rnd.randrange(3), T0 + timedelta(hours=rnd.randrange(200)), rnd.randrange(-3, 4)) for _ in range(300)]
    got = series.cumulative(spark.createDataFrame(data, "k int, ts timestamp, n int"), ["k"], "ts", "n", "total")
    for r in got.collect():
        assert r["total"] == sum(n for k, t, n in data if k == r["k"] and t <= r["ts"])


def test_chart_points(spark):
    half = T0 + timedelta(milliseconds=500)
    data = [(T0, 0, 0), (half, 0, 2), (day(1), 0, 2), (day(2), 0, 3), (T0, 1, 4), (half, 1, 4), (day(1), 1, 0), (day(2), 1, 0), (T0, 2, 0), (half, 2, 0), (day(1), 2, 0), (day(2), 2, 0)]
    got = series.chart_points(spark.createDataFrame(data, "ts timestamp, query_id int, value long"), F.lit("2020-02-01").cast("timestamp"))
    now = datetime(2020, 2, 1)
    assert {(r["query_id"], r["ts"], r["value"]) for r in got.collect()} == {
        (0, T0, 0), (0, half, 2), (0, day(2), 3), (0, now, 3),
        (1, T0 - timedelta(seconds=1), 0), (1, T0, 4), (1, day(1), 0), (1, now, 0), (2, now, 0),
    }


def test_extents(spark):
    row = series.extents(spark.createDataFrame([(0, T0, 3), (1, day(2), 1)], "query_id int, ts timestamp, value long")).first()
    assert tuple(row) == (T0, day(2), 3)


def test_empty(spark):
    none = frame(spark, [])
    assert temporal.coalesce_intervals(none, ["k"]).count() == 0
    assert temporal.subtract_intervals(none, none, ["k"]).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_fill_forward(spark, seed):
    """The greatest value up to each place, by going through all rows; several rows of a place, null keys and days without values."""
    rnd = random.Random(seed)
    data = [(rnd.choice([None, 1, 2]), T0 + timedelta(hours=rnd.randrange(300)), rnd.randrange(3), rnd.choice([None, None, rnd.randrange(50)]), i) for i in range(200)]
    df = spark.createDataFrame(data, "k int, ts timestamp, ord int, v int, i int")
    got = temporal.fill_forward(df, ["k"], "ts", ["ts", "ord"], "v").collect()
    assert len(got) == len(data)
    for r in got:
        seen = [v for k, t, o, v, _ in data if k == r["k"] and (t, o) <= (r["ts"], r["ord"]) and v is not None]
        assert r["v"] == max(seen, default=None)


def test_fill_forward_joins_by_equality(spark):
    df = spark.createDataFrame([(1, T0, 1)], "k int, ts timestamp, v int").repartition(2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = temporal.fill_forward(df, ["k"], "ts", ["ts"], "v")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_clipped_times_keep_answers(spark):
    """What holds at some dates is the same when each time counts from the first date after it."""
    rnd = random.Random(5)
    data = [(rnd.randrange(4), T0 + timedelta(days=rnd.randrange(40)), rnd.randrange(90)) for _ in range(120)]
    df = spark.createDataFrame(data, "k int, ts timestamp, v int")
    dates = ["2020-01-20", "2020-01-05", "2020-01-21"]
    whole = temporal.at_dates(temporal.running_max_intervals(df, ["k"], "v", "ts"), dates).select("as_of", "k", "v")
    less = temporal.clipped(df, "ts", dates)
    assert {str(r["ts"])[:10] for r in less.select("ts").distinct().collect()} <= set(dates)
    found = temporal.at_dates(temporal.running_max_intervals(less, ["k"], "v", "ts"), dates).select("as_of", "k", "v")
    assert sorted(found.collect()) == sorted(whole.collect()) and found.count()

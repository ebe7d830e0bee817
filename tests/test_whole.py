"""Queries give all of their results, not only those of some ids or dates: plain Python on the smallest tables."""

import sys

import pyarrow.parquet as pq
import pytest

from support import ROOT, SF

sys.path.insert(0, ROOT)
import __spark_entry__ as entry  # noqa: E402
from epochgraph.plans import queries as core  # noqa: E402
from test_oracles import compare, duck  # noqa: E402, F401


def rows(name, *columns):
    return zip(*(pq.read_table(f"{SF}/{name}.parquet", columns=[c])[c].to_pylist() for c in columns), strict=True)


def requirements():
    """Text of each distinct requirement, with its operator and numbers."""
    found = {}
    for line, quantity in rows("lineitem", "l_linenumber", "l_quantity"):
        op, a, b = min(line, 7), int(quantity) % 3, int(quantity) % 5
        found[["*", f"^{a}", f"^{a}.{b}", f"~{a}.{b}", f">={a}.{b}.0", f"<{a}.{b}.0", f"={a}.{b}"][op - 1]] = op, a, b
    return found


def fits(req, version):
    op, a, b = req
    x, y, z = version
    if op == 3:
        return x == a and (y >= b if a else y == b)
    return [True, x == a, None, (x, y) == (a, b), (x, y, z) >= (a, b, 0), (x, y, z) < (a, b, 0), (x, y) == (a, b)][op - 1]


def versions():
    """(id, package, time, numbers, whether a prerelease)."""
    for key, package, day, status in rows("orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"):
        yield key, package, day, (key % 3, key // 3 % 5, key // 15), status == "P" and key % 4 == 0


def test_all_versions_are_matched(spark):
    want = {(text, ".".join(map(str, v)), *v) for text, req in requirements().items() for _, _, _, v, pre in versions() if not pre and fits(req, v)}
    got = [tuple(r) for r in entry.queries()["semver_matching_all"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(int(num.split(".")[2]) for _, num, *_ in got) >= 20


def test_resolutions_at_all_times(spark):
    """Intervals between any two dates, by what each requirement fits."""
    offered, asked = {}, {}
    for key, package, day, version, pre in versions():
        if not pre:
            offered.setdefault(package, []).append((day, version, key))
    names = requirements()
    for package, line, quantity in rows("lineitem", "l_suppkey", "l_linenumber", "l_quantity"):
        op, a, b = min(line, 7), int(quantity) % 3, int(quantity) % 5
        text = ["*", f"^{a}", f"^{a}.{b}", f"~{a}.{b}", f">={a}.{b}.0", f"<{a}.{b}.0", f"={a}.{b}"][op - 1]
        asked[package, text] = names[text]
    want = set()
    for (package, text), req in asked.items():
        steps = []
        for day in sorted({d for d, v, _ in offered.get(package, []) if fits(req, v)}):
            best = max((v, k) for d, v, k in offered[package] if d <= day and fits(req, v))[1]
            if not steps or steps[-1][0] != best:
                steps.append((best, day))
        want |= {(package, text, best, day, after[1] if after else None) for (best, day), after in zip(steps, [*steps[1:], None], strict=False)}
    got = [tuple(r) for r in entry.queries()["resolve_requirements_over_time"](spark, SF).collect()]
    assert {(c, r, v, str(f)[:10], None if t.year == 9999 else str(t)[:10]) for c, r, v, f, t in got} == {(c, r, v, str(f)[:10], t and str(t)[:10]) for c, r, v, f, t in want}


@pytest.mark.parametrize("name, sql", [("transitive_over_time", core.TRANSITIVE_OVER_TIME_SQL), ("transitive_series", core.TRANSITIVE_SERIES_SQL)])
def test_intervals(duck, name, sql):  # noqa: F811
    """The SQL over intervals against the one that takes a snapshot at each date."""
    for a, b in ((sql, core.ORACLE_SQL[name]), (core.ORACLE_SQL[name], sql)):
        duck.sql(f"CREATE OR REPLACE TEMP TABLE a AS {a}")
        duck.sql(f"CREATE OR REPLACE TEMP TABLE b AS {b}")
        assert duck.sql("SELECT count(*) FROM a").fetchall()[0][0] > 0 and not duck.sql("SELECT * FROM a EXCEPT ALL SELECT * FROM b").fetchall()

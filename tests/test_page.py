"""Charts of long series, and which numbers are version parts."""

import random
import re

from epochgraph.functions import semver
from epochgraph.operators import series


def test_no_peak_is_lost(spark):
    """A long series by going through its points one by one, a short one beside it as it is."""
    rnd = random.Random(3)
    data = [(0, i * 7, float(rnd.randrange(4))) for i in range(3_000)] + [(1, i, float(i)) for i in range(50)]
    data[1234], data[2750] = (0, 1234 * 7, 99.0), (0, 2750 * 7, -3.0)
    got = {tuple(r) for r in series.thinned(spark.createDataFrame(data, "query_id int, ms long, shown double"), 100, 40).collect()}
    want, spans = {d for d in data if d[0]}, {}
    for q, ms, v in data[:3_000]:
        spans.setdefault(ms * 40 // (2_999 * 7 + 1), []).append((ms, v))
    for points in spans.values():
        kept = (points[0], points[-1], min(points, key=lambda p: (p[1], p[0])), max(points, key=lambda p: (p[1], p[0])))
        want |= {(0, *p) for p in kept}
    assert got == want and len(spans) == 40 and {(0, 1234 * 7, 99.0), (0, 2750 * 7, -3.0)} <= got


def test_numbers_of_versions():
    for n in (0, 1, 9, 10, 2**63, 2**64 - 1, 2**64 - 2, 18446744073709551599, 10**19, 10**19 - 1):
        assert re.match(semver.VERSION_PATTERN, f"1.{n}.0"), n
    for n in (2**64, 2**64 + 5, 18446744073709551620, 2 * 10**19, 10**20, "01", "00", "111111111111111111111"):
        assert not re.match(semver.VERSION_PATTERN, f"1.{n}.0"), n
    assert not re.match(semver.VERSION_PATTERN, "1.0.0-rc.01") and re.match(semver.VERSION_PATTERN, "1.0.0-rc.0a+007")

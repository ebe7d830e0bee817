"""Requirements against versions: columns against a matcher written from the rules in plain Python."""

import itertools

import pytest
from pyspark.sql import functions as F

from epochgraph.functions import semver


def key(identifiers):
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in identifiers.split(".")] if identifiers else []


def order(pre):
    return (not pre, key(pre))


def one(c, v):
    major, minor, patch, pre = v
    parts = [c.major, c.minor, c.patch]
    given = [p for p in parts if p is not None]
    mine = [major, minor, patch]
    equal = mine[: len(given)] == given and order(pre) == order(c.pre)
    above = mine[: len(given)] > given or len(given) == 3 and mine == given and order(pre) > order(c.pre)
    below = mine[: len(given)] < given or len(given) == 3 and mine == given and order(pre) < order(c.pre)
    low = len(given) < 3 or mine > given or mine == given and order(pre) >= order(c.pre)
    if c.op in ("exact", "wildcard"):
        return equal
    if c.op == "tilde":
        fixed = given[:2]
        if mine[: len(fixed)] != fixed:
            return False
        if len(given) == 3 and patch != c.patch:
            return patch > c.patch
        return order(pre) >= order(c.pre)
    if c.op == "caret":
        if major != c.major:
            return False
        if c.minor is None:
            return True
        if c.patch is None:
            return minor >= c.minor if major else minor == c.minor
        fixed = 1 if c.major else 2 if c.minor else 3
        return mine[:fixed] == given[:fixed] and low
    return {"greater": above, "greater_eq": above or equal, "less": below, "less_eq": below or equal}[c.op]


def matches(req, v):
    named = any(c.pre and (c.major, c.minor, c.patch) == v[:3] for c in req)
    return all(one(c, v) for c in req) and (not v[3] or named)


NUMBERS = [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 1, 0), (0, 1, 2), (0, 2, 0), (1, 0, 0), (1, 2, 3), (1, 2, 4), (1, 3, 0), (2, 0, 0)]
VERSIONS = [(*n, p) for n in NUMBERS for p in ("", "alpha", "alpha.2", "alpha.10", "rc.1")]
TEXTS = [f"{op}{body}" for op in ("", "=", ">", ">=", "<", "<=", "~", "^") for body in ("0", "1", "0.0", "0.1", "1.2", "0.0.1", "0.1.2", "1.2.3", "1.2.3-alpha.2", "0.0.0-rc.1")]
TEXTS += ["*", "1.*", "0.*", "1.2.*", "0.1.x", ">=1.0.0, <2.0.0", ">0.1, <=1.2.3-alpha.10", "^1, ~1.2"]


def text_of(v):
    return f"{v[0]}.{v[1]}.{v[2]}" + (f"-{v[3]}" if v[3] else "")


def test_truth_table(spark):
    pairs = spark.createDataFrame([(t, text_of(v)) for t, v in itertools.product(TEXTS, VERSIONS)], "req string, num string")
    found = pairs.select("req", "num", semver.matches(semver.requirement(F.col("req")), semver.version(F.col("num"))).alias("m")).collect()
    got = {(r["req"], r["num"]): r["m"] for r in found}
    wrong = [(t, text_of(v)) for t, v in itertools.product(TEXTS, VERSIONS) if got[t, text_of(v)] != matches(semver.parse_requirement(t), v)]
    assert not wrong, wrong[:10]
    assert 0.05 < sum(got.values()) / len(got) < 0.6


@pytest.mark.parametrize("text, shown", [("1", "^1"), ("1.*", "1.*"), ("*", "*"), (" >= 1.2 , <2 ", ">=1.2, <2"), ("=1.2.3-rc.1+build", "=1.2.3-rc.1"), ("~ 1.0", "~1.0"), ("1.2.x", "1.2.*")])
def test_parsers_agree(spark, text, shown):
    assert semver.requirement_label(semver.parse_requirement(text)) == shown
    row = spark.range(1).select(semver.requirement_text(semver.requirement(F.lit(text))).alias("a"), semver.requirement_text(semver.requirement_literal(semver.parse_requirement(text))).alias("b")).first()
    assert row["a"] == row["b"] == shown


@pytest.mark.parametrize("text", ["", "a", "1.2.3.4", "1.*.3", "^", "1,,2", "01", "*, 1", "1.2-alpha"])
def test_wrong_requirements(spark, text):
    with pytest.raises(semver.RequirementError):
        semver.parse_requirement(text)
    assert spark.range(1).select(semver.requirement(F.lit(text)).isNull()).first()[0]


def test_order(spark):
    ordered = ["0.0.1-alpha", "0.0.1-alpha.1", "0.0.1-alpha.2", "0.0.1-alpha.10", "0.0.1-alpha.beta", "0.0.1-beta", "0.0.1", "0.0.1+1", "0.0.1+01", "0.0.1+2", "0.0.1+a", "0.1.0", "18446744073709551615.0.0"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(ordered[::-1])], "i int, num string").orderBy(semver.version(F.col("num"))).collect()
    assert [r["num"] for r in rows] == ordered


@pytest.mark.parametrize("req, top, want", [("*", "1.2.3", "^1.2.3"), ("0.*", "0.3.1", "^0.3.1"), (">=0.1", "0.0.7", ">=0.1"), (">=0", "0.0.7", "^0.0.7"), ("^1", "1.5.0", "^1"), ("^0", "0.4.0", "^0.4.0"), (">1.0.0", "2.0.0-rc.1", "^2.0.0"), ("*", None, "*")])
def test_clamp(spark, req, top, want):
    v = semver.version(F.lit(top).cast("string"))
    assert spark.range(1).select(semver.requirement_text(semver.clamped(semver.requirement(F.lit(req)), v))).first()[0] == want


def test_ranges(spark):
    """A requirement's range holds just the stable versions that it takes, and it names a prerelease if it may take any."""
    pairs = spark.createDataFrame([(t, text_of(v)) for t, v in itertools.product([*TEXTS, ">1.2.3-alpha, <=2.0.0-rc.1", "=1.2.3, ^1"], VERSIONS)], "req string, num string")
    req, ver = semver.requirement(F.col("req")), semver.version(F.col("num"))
    key = semver.version_key(ver["major"], ver["minor"], ver["patch"])
    span = semver.stable_range(req)
    rows = pairs.select("req", "num", ver["pre_empty"].alias("stable"), semver.matches(req, ver).alias("m"), ((span["low"] <= key) & (key < span["high"])).alias("inside"), semver.names_prerelease(req).alias("pre")).collect()
    wrong = [(r["req"], r["num"]) for r in rows if r["stable"] and r["m"] != r["inside"] or not r["stable"] and r["m"] and not r["pre"]]
    assert not wrong, wrong[:10]
    assert sum(r["m"] for r in rows if r["stable"]) > 100


def test_what_may_be_too_wide(spark):
    """No requirement is ever clamped that its range says can't be, and of those that may be most are by some version."""
    texts = [t for t in TEXTS if "-" not in t] + ["^1.2.3", "^2", "^2.1", "~0.0.1", "<0.0.1", ">=0.0.3, <0.0.4", "=2.0.0", "=0.1.0", "=1.0.0", ">=2.0.1, <3"]
    tops = [f"{a}.{b}.{c}" for a in range(4) for b in range(4) for c in range(5)]
    pairs = spark.createDataFrame([(t, v) for t in texts for v in tops], "text string, num string")
    req, top = semver.requirement(F.col("text")), semver.version(F.col("num"))
    span = semver.stable_range(req)
    rows = pairs.select("text", semver.may_be_too_wide(span["low"], span["high"]).alias("may"), (semver.requirement_text(semver.clamped(req, top)) != semver.requirement_text(req)).alias("is")).collect()
    ever = {t: any(r["is"] for r in rows if r["text"] == t) for t in texts}
    may = {r["text"]: r["may"] for r in rows}
    assert not [t for t in texts if ever[t] and not may[t]]
    assert not may["^1.2.3"] and not may["^2.1"] and may["^2"] and may["*"] and may["0"] and [t for t in texts if may[t] and not ever[t]] == []

"""Semantic versions and requirements as plain columns: parsing, order, matching.

A version is a struct whose order is the semantic one, so ``max`` and comparisons need no function. A requirement is an array of
comparators that must all hold. Numbers are DECIMAL(20,0), as components may use all of unsigned 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "DECIMAL(20,0)"
#: Numeric identifiers come before others and compare by length, then digits; others by their bytes.
IDENTIFIER = "STRUCT<alnum: INT, len: INT, txt: STRING>"
BUILD_IDENTIFIER = "STRUCT<alnum: INT, len: INT, txt: STRING, rawlen: INT>"
VERSION = f"STRUCT<major: {NUMBER}, minor: {NUMBER}, patch: {NUMBER}, pre_empty: BOOLEAN, pre: ARRAY<{IDENTIFIER}>, build: ARRAY<{BUILD_IDENTIFIER}>>"
COMPARATOR = f"STRUCT<op: STRING, major: {NUMBER}, minor: {NUMBER}, patch: {NUMBER}, pre_empty: BOOLEAN, pre: ARRAY<{IDENTIFIER}>>"
REQUIREMENT = f"ARRAY<{COMPARATOR}>"

#: Operator signs and their names; a bare version is a caret, one with a wildcard part a wildcard.
OPERATORS = {"=": "exact", ">": "greater", ">=": "greater_eq", "<": "less", "<=": "less_eq", "~": "tilde", "^": "caret"}
#: Operators in their order.
ORDERED = ("exact", "greater", "greater_eq", "less", "less_eq", "tilde", "caret", "wildcard")
SIGNS = {name: sign for sign, name in OPERATORS.items()} | {"wildcard": ""}

#: The greatest number that a part may be.
GREATEST = 2**64 - 1


def _up_to(greatest: int) -> str:
    """A pattern of the numbers up to ``greatest``, without leading zeros: those with fewer digits, then those below it from some digit on."""
    digits = str(greatest)
    below = [f"{digits[:i]}[{int(i == 0)}-{int(d) - 1}][0-9]{{{len(digits) - i - 1}}}" for i, d in enumerate(digits) if int(d) > int(i == 0)]
    return "|".join(["0", f"[1-9][0-9]{{0,{len(digits) - 2}}}", *below, digits])


_PART = _up_to(GREATEST)
_IDENTIFIERS = r"[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*"
_PRE = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
_PRES = rf"{_PRE}(?:\.{_PRE})*"
VERSION_PATTERN = rf"^({_PART})\.({_PART})\.({_PART})(?:-({_PRES}))?(?:\+({_IDENTIFIERS}))?$"
COMPARATOR_PATTERN = rf"^ *(>=|<=|=|>|<|~|\^)? *({_PART})(?:\.({_PART}|[*xX])(?:\.({_PART}|[*xX])(?:-({_PRES}))?(?:\+({_IDENTIFIERS}))?)?)? *$"
ANY_PATTERN = r"^ *[*xX] *$"


# Columns from text


def _identifiers(text: Column, build: bool = False) -> Column:
    def one(x: Column) -> Column:
        digits = x.rlike("^[0-9]+$")
        trimmed = F.when(digits, F.regexp_replace(x, "^0+(?=.)", "")).otherwise(x) if build else x
        parts = [F.when(digits, 0).otherwise(1).alias("alnum"), F.when(digits, F.length(trimmed)).otherwise(0).alias("len"), trimmed.alias("txt")]
        return F.struct(*parts, *([F.length(x).alias("rawlen")] if build else []))

    kind = f"ARRAY<{BUILD_IDENTIFIER if build else IDENTIFIER}>"
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(kind)).otherwise(F.transform(F.split(text, r"\."), one)).cast(kind)


def version(text: Column) -> Column:
    """The version that a text spells; null if it spells none."""
    group = [F.regexp_extract(text, VERSION_PATTERN, i) for i in range(1, 6)]
    made = F.struct(*(group[i].cast(NUMBER).alias(n) for i, n in enumerate(("major", "minor", "patch"))), (group[3] == "").alias("pre_empty"), _identifiers(group[3]).alias("pre"), _identifiers(group[4], build=True).alias("build"))
    return F.when(text.rlike(VERSION_PATTERN), made.cast(VERSION))


def version_of(major: Column, minor: Column, patch: Column, pre: Column | None = None) -> Column:
    """A version without build metadata from its parts; ``pre`` is dotted text."""
    pre = F.lit("") if pre is None else F.coalesce(pre, F.lit(""))
    return F.struct(major.cast(NUMBER).alias("major"), minor.cast(NUMBER).alias("minor"), patch.cast(NUMBER).alias("patch"), (pre == "").alias("pre_empty"), _identifiers(pre).alias("pre"), F.array().cast(f"ARRAY<{BUILD_IDENTIFIER}>").alias("build")).cast(VERSION)


def comparator(op: Column, major: Column, minor: Column, patch: Column, pre: Column | None = None) -> Column:
    pre = F.lit("") if pre is None else F.coalesce(pre, F.lit(""))
    return F.struct(op.alias("op"), major.cast(NUMBER).alias("major"), minor.cast(NUMBER).alias("minor"), patch.cast(NUMBER).alias("patch"), (pre == "").alias("pre_empty"), _identifiers(pre).alias("pre")).cast(COMPARATOR)


def requirement(text: Column) -> Column:
    """The comparators that a text spells, none for ``*``; null if it spells no requirement."""

    def one(part: Column) -> Column:
        sign, *group = (F.regexp_extract(part, COMPARATOR_PATTERN, i) for i in range(1, 6))
        wild = group[1].rlike("^[*xX]$") | group[2].rlike("^[*xX]$")
        op = F.when(sign == "", F.when(wild, "wildcard").otherwise("caret"))
        op = reduce(lambda c, item: c.when(sign == item[0], item[1]), OPERATORS.items(), op)
        number = [F.when(g.rlike("^[0-9]+$"), g) for g in group[:3]]
        return comparator(op, number[0], number[1], number[2], group[3])

    parts = F.split(text, ",")
    sound = F.forall(parts, lambda p: p.rlike(COMPARATOR_PATTERN) & ~p.rlike(rf"^[^.]*\.[*xX]\.(?:{_PART})"))
    return F.when(text.rlike(ANY_PATTERN), F.array().cast(REQUIREMENT)).when(sound & (F.size(parts) <= 32), F.transform(parts, one).cast(REQUIREMENT))


# Matching


def _pre(x: Column) -> Column:
    """What prereleases compare by: none comes last."""
    return F.struct(x["pre_empty"], x["pre"])


def _ordered(c: Column, v: Column, above: Callable[[Column, Column], Column]) -> Column:
    """Strictly above (or below) the comparator, by the first part that differs; a part not given decides nothing."""
    case = F.when(v["major"] != c["major"], above(v["major"], c["major"]))
    for part in ("minor", "patch"):
        case = case.when(c[part].isNull(), False).when(v[part] != c[part], above(v[part], c[part]))
    return case.otherwise(above(_pre(v), _pre(c)))


def _exact(c: Column, v: Column) -> Column:
    given = [(c[part].isNull() | (v[part] == c[part])) for part in ("minor", "patch")]
    return (v["major"] == c["major"]) & given[0] & given[1] & (_pre(v) == _pre(c))


def _tilde(c: Column, v: Column) -> Column:
    case = F.when(v["major"] != c["major"], False).when(c["minor"].isNotNull() & (v["minor"] != c["minor"]), False)
    return case.when(c["patch"].isNotNull() & (v["patch"] != c["patch"]), v["patch"] > c["patch"]).otherwise(_pre(v) >= _pre(c))


def _caret(c: Column, v: Column) -> Column:
    """Compatible: no part left of or at the leftmost nonzero one may change, and none may fall below."""
    stable = c["major"] > 0
    case = F.when(v["major"] != c["major"], False).when(c["minor"].isNull(), True)
    case = case.when(c["patch"].isNull(), F.when(stable, v["minor"] >= c["minor"]).otherwise(v["minor"] == c["minor"]))
    case = case.when(v["minor"] != c["minor"], stable & (v["minor"] > c["minor"]))
    case = case.when(v["patch"] != c["patch"], (stable | (c["minor"] > 0)) & (v["patch"] > c["patch"]))
    return case.otherwise(_pre(v) >= _pre(c))


def comparator_matches(c: Column, v: Column) -> Column:
    greater, less = _ordered(c, v, lambda a, b: a > b), _ordered(c, v, lambda a, b: a < b)
    return (
        F.when(c["op"].isin("exact", "wildcard"), _exact(c, v))
        .when(c["op"] == "greater", greater)
        .when(c["op"] == "greater_eq", _exact(c, v) | greater)
        .when(c["op"] == "less", less)
        .when(c["op"] == "less_eq", _exact(c, v) | less)
        .when(c["op"] == "tilde", _tilde(c, v))
        .otherwise(_caret(c, v))
    )


def matches(req: Column, v: Column) -> Column:
    """Whether all comparators hold; a prerelease also needs one with a prerelease of the same three numbers."""
    names_pre = F.exists(req, lambda c: (c["major"] == v["major"]) & c["minor"].eqNullSafe(v["minor"]) & c["patch"].eqNullSafe(v["patch"]) & ~c["pre_empty"])
    return F.forall(req, lambda c: comparator_matches(c, v)) & (v["pre_empty"] | names_pre)


def names_prerelease(req: Column) -> Column:
    """Whether a requirement can take prereleases at all."""
    return F.exists(req, lambda c: ~c["pre_empty"])


def version_key(major: Column, minor: Column, patch: Column) -> Column:
    """A text that orders as the three numbers do."""
    return F.concat(*(F.lpad(n.cast("string"), 21, "0") for n in (major, minor, patch)))


def may_be_too_wide(low: Column, high: Column) -> Column:
    """Whether a range of version keys holds any version that is the first incompatible one after another: M.0.0 or 0.m.0 from 2 on, 0.0.p from 1 on."""
    major, minor, patch = numbers_of_key(low)
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    again = ((minor > 0) | (patch > 0)).cast("int")
    majors = version_key(F.greatest(major + again, two), zero, zero) < high
    minors = (major == 0) & (version_key(zero, F.greatest(minor + (patch > 0).cast("int"), two), zero) < high)
    patches = (major == 0) & (minor == 0) & (version_key(zero, zero, F.greatest(patch, one)) < high)
    return majors | minors | patches


def numbers_of_key(key: Column) -> tuple[Column, Column, Column]:
    """The three numbers that a ``version_key`` was made of."""
    return tuple(F.substring(key, 1 + 21 * i, 21).cast(NUMBER) for i in range(3))


def caret_text(major: Column, minor: Column, patch: Column) -> Column:
    """The text of the requirement to stay compatible with three numbers."""
    return F.concat(F.lit("^"), F.concat_ws(".", *(n.cast("string") for n in (major, minor, patch))))


def stable_range(req: Column) -> Column:
    """struct<low, high>: the stable versions that a requirement takes are those with ``low <= version_key < high``; none if low >= high.

    Each comparator is such a range, so all of them together are the greatest low and the least high end. A prerelease in a comparator
    stands before its numbers, so among stable versions it is as if it weren't there, but that nothing equals it and that the numbers
    themselves are above it.
    """
    zero = F.lit(0).cast(NUMBER)
    number = lambda *parts: F.struct(*(F.coalesce(p, zero).cast("DECIMAL(21,0)").alias(n) for p, n in zip(parts, ("a", "b", "c"), strict=True)))
    bottom, top = number(zero, zero, zero), number(*[F.lit("1" + 20 * "0").cast("DECIMAL(21,0)")] * 3)

    def one(c: Column) -> Column:
        op, major, minor, patch = c["op"], c["major"], c["minor"], c["patch"]
        least = number(major, minor, patch)
        next_major, next_minor, next_patch = number(major + 1, zero, zero), number(major, minor + 1, zero), number(major, minor, patch + 1)
        # the first version after those that share the parts given; nothing stable equals a prerelease
        after = F.when(~c["pre_empty"], least).when(minor.isNull(), next_major).when(patch.isNull(), next_minor).otherwise(next_patch)
        caret = F.when((major > 0) | minor.isNull(), next_major).when((minor > 0) | patch.isNull(), next_minor).otherwise(next_patch)
        low = F.when(op.isin("less", "less_eq"), bottom).when(op == "greater", after).otherwise(least)
        high = F.when(op.isin("greater", "greater_eq"), top).when(op == "less", least).when(op == "tilde", F.when(minor.isNull(), next_major).otherwise(next_minor)).when(op == "caret", caret).otherwise(after)
        return F.struct(low.alias("low"), high.alias("high"))

    def both(a: Column, c: Column) -> Column:
        b = one(c)
        return F.struct(F.greatest(a["low"], b["low"]).alias("low"), F.least(a["high"], b["high"]).alias("high"))

    key = lambda v: F.concat(*(F.lpad(v[n].cast("string"), 21, "0") for n in "abc"))
    return F.aggregate(req, F.struct(bottom.alias("low"), top.alias("high")), both, lambda r: F.struct(key(r["low"]).alias("low"), key(r["high"]).alias("high")))


def compiled(req: Column) -> Column:
    """What matching and clamping need of a requirement: struct<may_pre, may_widen, low, high>; whether it may take prereleases, whether it may ever be too wide, its range."""
    span = F.transform(F.array(stable_range(req)), lambda r: F.struct(names_prerelease(req).alias("may_pre"), may_be_too_wide(r["low"], r["high"]).alias("may_widen"), r["low"].alias("low"), r["high"].alias("high")))
    return span[0]


def next_incompatible(v: Column) -> Column:
    """The least version number that a caret on ``v`` excludes."""
    zero = F.lit(0)
    stable, minor = v["major"] > 0, v["minor"] > 0
    major = F.when(stable, v["major"] + 1).otherwise(zero)
    return version_of(major, F.when(~stable & minor, v["minor"] + 1).otherwise(zero), F.when(~stable & ~minor, v["patch"] + 1).otherwise(zero))


def caret_on(v: Column) -> Column:
    """The requirement to stay compatible with a version's three numbers, whatever its prerelease."""
    return F.array(comparator(F.lit("caret"), v["major"], v["minor"], v["patch"])).cast(REQUIREMENT)


def clamped(req: Column, greatest: Column) -> Column:
    """A requirement that would take the next incompatible version becomes a caret on the greatest one; as it is if there is none yet."""
    return F.when(greatest.isNotNull() & matches(req, next_incompatible(greatest)), caret_on(greatest)).otherwise(req)


def requirement_order(req: Column) -> Column:
    """What requirements are ordered by: comparator by comparator, the operator first, a part not given before any number; fewer come first."""
    rank = lambda op: reduce(lambda c, item: c.when(op == item[1], item[0]), list(enumerate(ORDERED))[1:], F.when(op == ORDERED[0], 0))
    return F.transform(req, lambda c: F.struct(rank(c["op"]).alias("op"), c["major"], c["minor"], c["patch"], c["pre_empty"], c["pre"]))


def requirement_text(req: Column) -> Column:
    """Canonical text: ``*`` if empty, else the comparators joined."""
    sign = lambda op: reduce(lambda c, item: c.when(op == item[0], item[1]), list(SIGNS.items())[1:], F.when(op == "exact", "="))

    def one(c: Column) -> Column:
        star = F.lit(".*")
        wild = c["op"] == "wildcard"
        tail = F.when(c["minor"].isNull(), F.when(wild, star).otherwise("")).otherwise(F.concat(F.lit("."), c["minor"].cast("string"), F.when(c["patch"].isNull(), F.when(wild, star).otherwise("")).otherwise(F.concat(F.lit("."), c["patch"].cast("string")))))
        pre = F.when(c["pre_empty"], "").otherwise(F.concat(F.lit("-"), F.array_join(F.transform(c["pre"], lambda p: p["txt"]), ".")))
        return F.concat(sign(c["op"]), c["major"].cast("string"), tail, pre)

    return F.when(F.size(req) == 0, "*").otherwise(F.array_join(F.transform(req, one), ", "))


# The driver's side: requirements of queries


class RequirementError(ValueError):
    """A text that spells no version requirement."""


@dataclass(frozen=True)
class Comparator:
    op: str
    major: int
    minor: int | None = None
    patch: int | None = None
    pre: str = ""

    def __str__(self) -> str:
        parts = [str(self.major)]
        for n in (self.minor, self.patch):
            if n is None:
                if self.op == "wildcard":
                    parts.append("*")
                break
            parts.append(str(n))
        return SIGNS[self.op] + ".".join(parts) + (f"-{self.pre}" if self.pre else "")


def parse_requirement(text: str) -> tuple[Comparator, ...]:
    """The comparators of a query's requirement; an error names the part that is wrong."""
    if re.match(ANY_PATTERN, text):
        return ()
    parts = text.split(",")
    if len(parts) > 32:
        raise RequirementError("too many comparators")
    out = []
    for part in parts:
        m = re.match(COMPARATOR_PATTERN, part)
        if not m or m[3] in ("*", "x", "X") and m[4] and m[4].isdigit():
            raise RequirementError(f"unexpected {part.strip()!r} in version requirement {text!r}")
        for n in (m[2], m[3], m[4]):
            if n and n.isdigit() and int(n) >= 2**64:
                raise RequirementError(f"{n} is out of range in {text!r}")
        for identifier in (m[5] or "").split("."):
            if re.fullmatch("0[0-9]+", identifier):
                raise RequirementError(f"leading zero in {text!r}")
        wild = m[3] in ("*", "x", "X") or m[4] in ("*", "x", "X")
        op = OPERATORS[m[1]] if m[1] else "wildcard" if wild else "caret"
        out.append(Comparator(op, int(m[2]), *(int(n) if n and n.isdigit() else None for n in (m[3], m[4])), m[5] or ""))
    return tuple(out)


def requirement_label(comparators: tuple[Comparator, ...]) -> str:
    return ", ".join(map(str, comparators)) or "*"


def requirement_literal(comparators: tuple[Comparator, ...] | None) -> Column:
    """A requirement as a constant column; None, which any version meets, is null."""
    if comparators is None:
        return F.lit(None).cast(REQUIREMENT)
    return F.array(*(comparator(F.lit(c.op), F.lit(c.major), F.lit(c.minor), F.lit(c.patch), F.lit(c.pre)) for c in comparators)).cast(REQUIREMENT)

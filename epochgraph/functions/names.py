"""Names of packages, users and teams: which are valid, and the keys by which they are equal."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKAGE_PATTERN = r"^[A-Za-z][A-Za-z0-9_-]{0,63}$"
USER_PATTERN = r"^(?=.{1,39}$)[0-9A-Za-z]+(?:-[0-9A-Za-z]+)*$"


def package_key(name: Column) -> Column:
    """Underscores and hyphens are the same; case is not."""
    return F.translate(name, "_", "-")


def user_key(name: Column) -> Column:
    """Case doesn't count in users and teams."""
    return F.lower(name)


def valid_package(name: str) -> bool:
    return re.fullmatch(PACKAGE_PATTERN, name) is not None


def valid_user(name: str) -> bool:
    return re.fullmatch(USER_PATTERN, name) is not None


def package_is_valid(name: Column) -> Column:
    return name.rlike(PACKAGE_PATTERN)


def user_is_valid(name: Column) -> Column:
    return name.rlike(USER_PATTERN)


def is_team(name: Column) -> Column:
    return F.contains(name, F.lit("/"))

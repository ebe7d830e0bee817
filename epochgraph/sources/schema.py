"""Schemas of the tables that the engine works on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.semver import REQUIREMENT, VERSION

ENABLES = "ARRAY<STRUCT<crate_id: BIGINT, feature: STRING>>"
FEATURES = f"ARRAY<STRUCT<feature: STRING, enables: {ENABLES}, weak_enables: {ENABLES}>>"
RELEASES = f"version_id BIGINT, crate_id BIGINT, num STRING, ver {VERSION}, created_at TIMESTAMP, load_ord BIGINT, features {FEATURES}"
DEPENDENCIES = f"dep_id BIGINT, version_id BIGINT, crate_id BIGINT, req {REQUIREMENT}, req_key STRING, may_pre BOOLEAN, may_widen BOOLEAN, low STRING, high STRING, feature STRING, default_features BOOLEAN, features ARRAY<STRING>, kind STRING"
PREDICATES = f"query_id INT, crate_id BIGINT, req {REQUIREMENT}"
PACKAGES = "crate_id BIGINT, name STRING"
#: Users and teams; ``owner`` is the name as first written, compared without regard to case.
OWNERS = "owner STRING, kind STRING, owner_id BIGINT"
OWNED = "kind STRING, owner_id BIGINT, crate_id BIGINT"


@dataclass(frozen=True)
class Registry:
    """A package registry: its packages, releases and dependencies, and who owns what."""

    packages: DataFrame
    releases: DataFrame
    dependencies: DataFrame
    owners: DataFrame
    owned: DataFrame

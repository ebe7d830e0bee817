"""Known gaps of the public registry's dumps: packages and releases that were deleted, put back from fixed values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, semver
from .schema import FEATURES

# What is missing from the dumps.

PACKAGES = ["futures", "git-version", "lazy_static", "partial-io", "quickcheck", "tokio-core", "tokio-io", "vela-utils", "xcm", "xcm-executor"]

#: Package, version, time of publication.
RELEASES = [
    ("git-version", "0.1.0", "2017-10-18 13:53:11"),
    ("git-version", "0.1.1", "2017-10-18 13:55:40"),
    ("git-version", "0.1.2", "2017-10-18 13:57:15"),
    ("git-version", "0.2.0", "2018-04-05 09:14:16"),
    ("partial-io", "0.1.0", "2017-05-26 02:38:58"),
    ("partial-io", "0.1.1", "2017-05-27 00:56:37"),
    ("partial-io", "0.2.0", "2017-05-30 21:01:28"),
    ("partial-io", "0.2.1", "2017-05-30 21:47:41"),
    ("partial-io", "0.2.2", "2017-06-12 05:26:52"),
    ("partial-io", "0.2.3", "2017-07-20 20:01:22"),
    ("partial-io", "0.2.4", "2017-08-19 23:37:51"),
    ("partial-io", "0.2.5", "2017-11-18 02:26:25"),
    ("partial-io", "0.3.0", "2018-01-12 22:15:15"),
    ("xcm", "0.0.0", "2021-03-09 05:51:34"),
    ("xcm-executor", "0.0.0", "2021-03-09 06:21:39"),
]

#: What every release of partial-io depends on: package, requirement, feature ("" for the package itself), kind.
PARTIAL_IO_DEPENDENCIES = [
    ("futures", "^0.1", "futures", "normal"),
    ("lazy_static", "^0.2", "", "dev"),
    ("quickcheck", "^0.4", "quickcheck", "normal"),
    ("quickcheck", "^0.4", "", "dev"),
    ("tokio-core", "^0.1", "", "dev"),
    ("tokio-io", "^0.1", "tokio-io", "normal"),
]
#: But for the newest, which asks for these.
NEWEST_PARTIAL_IO, NEWEST_REQUIREMENTS = "0.3.0", {"lazy_static": "^1.0", "quickcheck": "^0.6"}
#: The one feature that every release of partial-io declares, and the own features that it enables.
PARTIAL_IO_FEATURE, PARTIAL_IO_ENABLES = "tokio", ["tokio-io", "futures"]


#: Ids that are looked at first, as most tables have room among them.
NEAR = 4096


class _Mend:
    @staticmethod
    def _unused(df: DataFrame, column: str, first: int, n: int) -> list[int]:
        """The ``n`` least ids from ``first`` on that aren't used: those of the first ids, or else by one pass over all, however long they run without a gap.

        In that pass used ids are bits of blocks of 64. The first blocks with room hold the answer, and only these come to the driver;
        where blocks are missing, enough of them follow the last one before.
        """
        used = {r[0] for r in df.filter((F.col(column) >= first) & (F.col(column) < first + NEAR)).select(column).distinct().collect()}
        near = [i for i in range(first, first + NEAR) if i not in used][:n]
        if len(near) == n:
            return near
        more = n // 64 + 2
        bits = df.filter(F.col(column) >= first).groupBy(F.shiftright(column, 6).alias("block")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(`{column}` & 63 AS INT))")).alias("bits"))
        step = F.explode(F.sequence(F.lit(0), F.lit(more)))
        bits = bits.select("block", "bits", step.alias("k")).select((F.col("block") + F.col("k")).alias("block"), F.when(F.col("k") == 0, F.col("bits")).otherwise(0).alias("bits"))
        begin = df.sparkSession.range(first >> 6, (first >> 6) + more).select(F.col("id").alias("block"), F.lit(0).cast("long").alias("bits"))
        blocks = bits.unionByName(begin).groupBy("block").agg(F.bit_or("bits").alias("bits"))
        rows = blocks.filter("bits <> -1").orderBy("block").limit(n + 1).collect()  # each has room, the first one maybe only before ``first``
        return [i for r in rows for i in range(64 * r["block"], 64 * r["block"] + 64) if i >= first and not r["bits"] >> i % 64 & 1][:n]

    def packages(self, packages: DataFrame) -> tuple[DataFrame, int]:
        """With the missing packages under the least unused ids from 1 on; how many there were."""
        spark = packages.sparkSession
        keys = [p.replace("_", "-") for p in PACKAGES]
        known = {r[0] for r in packages.select(names.package_key(F.col("name")).alias("k")).filter(F.col("k").isin(keys)).collect()}
        missing = [p for p, k in zip(PACKAGES, keys, strict=True) if k not in known]
        if not missing:
            return packages, 0
        ids = self._unused(packages, "crate_id", 1, len(missing))
        return packages.unionByName(spark.createDataFrame(list(zip(ids, missing, strict=True)), "crate_id long, name string")), len(missing)

    def releases(self, spark: SparkSession, packages: DataFrame, releases: DataFrame, dependencies: DataFrame, numbers: DataFrame, dep_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """With the missing releases and their dependency rows, under the least unused ids from 0 on.

        ``numbers`` (version_id, crate_id, num, load_ord) and ``dep_ids`` (dep_id) are the same rows as the raw tables have them, so
        that what is looked up here needn't make the prepared ones. A package that has one of these versions already fails the job: the dump was mended at its source.
        """
        keys = [p.replace("_", "-") for p in PACKAGES]
        found = packages.withColumn("k", names.package_key(F.col("name"))).filter(F.col("k").isin(keys)).collect()
        ids = {r["k"]: r["crate_id"] for r in found}
        version_ids = self._unused(numbers, "version_id", 0, len(RELEASES))
        rows, deps = [], []
        for i, (name, num, ts) in enumerate(RELEASES):
            crate = ids[name.replace("_", "-")]
            features = [(PARTIAL_IO_FEATURE, [(crate, f) for f in PARTIAL_IO_ENABLES], [])] if name == "partial-io" else []
            rows.append((version_ids[i], crate, num, ts, i, features))
            if name == "partial-io":
                newer = NEWEST_REQUIREMENTS if num == NEWEST_PARTIAL_IO else {}
                deps += [(version_ids[i], ids[d.replace("_", "-")], newer.get(d, req), feature, kind) for d, req, feature, kind in PARTIAL_IO_DEPENDENCIES]
        put_back = reduce(or_, ((F.col("crate_id") == r[1]) & (F.col("num") == r[2]) for r in rows))
        last, clash = numbers.agg(F.max("load_ord"), F.max(put_back)).first()
        if clash:
            raise ValueError("a release to be put back is in the dump")
        last = last or 0
        added = spark.createDataFrame(rows, f"version_id long, crate_id long, num string, created_at string, load_ord long, features {FEATURES}")
        added = added.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("load_ord", F.col("load_ord") + last + 1).withColumn("ver", semver.version(F.col("num")))
        ids_of_deps = self._unused(dep_ids, "dep_id", 0, len(deps))
        extra = spark.createDataFrame([(i, *d) for i, d in zip(ids_of_deps, deps, strict=True)], "dep_id long, version_id long, crate_id long, req_text string, feature string, kind string")
        extra = extra.withColumn("default_features", F.lit(True)).withColumn("features", F.array().cast("array<string>"))
        return releases.unionByName(added.select(releases.columns)), dependencies.unionByName(extra.select(dependencies.columns))


#: All requirements that are put back.
TEXTS = sorted({d[1] for d in PARTIAL_IO_DEPENDENCIES} | set(NEWEST_REQUIREMENTS.values()))

mend = _Mend()

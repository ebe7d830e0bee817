"""A registry made from the star-schema tables, so that every operator can run on them.

Orders are releases of their customer's package; line items are dependencies of their order's release on the supplier's package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semver
from .schema import FEATURES, Registry
from .shared import durable, parts_for


#: Prereleases of the dump's releases, from the lowest on but for the last, which is the lowest of all.
PRERELEASES = ("a.b", "alpha", "alpha.1", "alpha.2", "alpha.10", "1")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("crate_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))


def releases(spark: SparkSession, sf_dir: str, features: bool = True) -> DataFrame:
    """Every fourth release declares features: defaults that enable ``std``, and ``extra``, which enables ``std`` here and in a dependency."""
    key = F.col("o_orderkey")
    pre = F.when((F.col("o_orderstatus") == "P") & (key % 4 == 0), "alpha")
    parts = (key % 3, F.expr("(o_orderkey div 3) % 5"), F.expr("o_orderkey div 15"))
    orders = _table(spark, sf_dir, "orders")
    if features:
        least = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("other"))
        orders = orders.join(least, "o_orderkey", "left")
        made = F.expr(f"""
            CASE WHEN o_orderkey % 4 = 0 THEN array(
              named_struct('feature', 'default', 'enables', array(named_struct('crate_id', o_custkey, 'feature', 'std')), 'weak_enables', array()),
              named_struct('feature', 'std', 'enables', array(), 'weak_enables', array()),
              named_struct('feature', 'extra', 'enables', IF(other IS NULL, array(named_struct('crate_id', o_custkey, 'feature', 'std')),
                array(named_struct('crate_id', o_custkey, 'feature', 'std'), named_struct('crate_id', other, 'feature', 'std'))), 'weak_enables', array())
            ) ELSE array() END""")
    else:
        made = F.array()
    text = F.concat(F.concat_ws(".", *(p.cast("string") for p in parts)), F.when(pre.isNotNull(), "-alpha").otherwise(""))
    return orders.select(key.alias("version_id"), F.col("o_custkey").alias("crate_id"), text.alias("num"), semver.version_of(*parts, pre).alias("ver"), F.col("o_orderdate").cast("timestamp").alias("created_at"), key.alias("load_ord"), made.cast(FEATURES).alias("features"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requirement's numbers come from the whole part of the quantity; none counts as 0."""
    lineitem = _table(spark, sf_dir, "lineitem")
    rows = lineitem.withColumn("_q", F.coalesce(F.floor("l_quantity"), F.lit(0)).cast("int")).select("l_orderkey", "l_suppkey", "l_linenumber", F.expr("_q % 3").alias("a"), F.expr("_q % 5").alias("b"), "l_returnflag", "l_linestatus", (F.col("l_tax") >= 0.04).alias("optional"), (F.col("l_discount") < 0.05).alias("defaults"), (F.col("l_discount") >= 0.08).alias("extra"))
    rows = rows.repartition(parts_for(lineitem), "l_orderkey").distinct()  # the one shuffle of the distinct rows, in tasks of a bounded size
    kind = F.when(F.col("l_returnflag") != "N", "dev").when(F.col("l_linestatus") == "F", "normal").otherwise("build")
    return with_requirements(rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("dep_id"), F.col("l_orderkey").alias("version_id"), F.col("l_suppkey").alias("crate_id"), _text().alias("req_text"),
        F.when(F.col("optional"), F.concat(F.lit("c"), F.col("l_suppkey").cast("string"))).otherwise("").alias("feature"), F.col("defaults").alias("default_features"),
        F.when(F.col("extra"), F.array(F.lit("extra"))).otherwise(F.array().cast("array<string>")).alias("features"), kind.alias("kind"),
    ))


def _text() -> Column:
    """A line item's requirement, of its number and the parts ``a`` and ``b`` of its quantity."""
    return F.expr("""CASE l_linenumber WHEN 1 THEN '*' WHEN 2 THEN concat('^', a) WHEN 3 THEN concat('^', a, '.', b) WHEN 4 THEN concat('~', a, '.', b)
        WHEN 5 THEN concat('>=', a, '.', b, '.0') WHEN 6 THEN concat('<', a, '.', b, '.0') ELSE concat('=', a, '.', b) END""")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req_text, req, req_key and the parts of ``semver.compiled``) of ``dependencies``, each text once: no dependency is made for them."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("_q", F.coalesce(F.floor("l_quantity"), F.lit(0)).cast("int")).select("l_linenumber", F.expr("_q % 3").alias("a"), F.expr("_q % 5").alias("b"))
    return parsed(rows.distinct().select(_text().alias("req_text")))


def with_requirements(rows: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Dependency rows with the columns of ``parsed`` for their ``req_text``; ``texts`` has all of these if they are told by less than the rows."""
    found = parsed(rows if texts is None else texts)
    return rows.join(found, "req_text").select("dep_id", "version_id", "crate_id", "req", "req_key", "may_pre", "may_widen", "low", "high", "feature", "default_features", "features", "kind")


def parsed(texts: DataFrame) -> DataFrame:
    """(req_text, ``req``, ``req_key`` and the parts of ``semver.compiled``) of each distinct ``req_text``.

    Each is parsed and compiled once, and a wrong one fails the job; the few texts are checkpointed, as plans would hold the long
    expressions once for each use.
    """
    texts = texts.filter("req_text IS NOT NULL").select("req_text").distinct().withColumn("req", semver.requirement(F.col("req_text")))
    texts = texts.withColumn("req", F.when(F.col("req").isNull(), F.raise_error(F.concat(F.lit("wrong version requirement: "), F.col("req_text")))).otherwise(F.col("req")))
    found = durable(texts.withColumns({"req_key": semver.requirement_text(F.col("req")), "made": semver.compiled(F.col("req"))}))
    return found.select("req_text", "req", "req_key", "made.*")


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    """Nations are users who own their suppliers' packages; regions with nations are teams that own the same."""
    supplier, nation, region = (_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    users = nation.select(F.col("n_name").alias("owner"), F.lit("user").alias("kind"), F.col("n_nationkey").cast("long").alias("owner_id"))
    teams = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.concat_ws("/", "r_name", "n_name").alias("owner"), F.lit("team").alias("kind"), F.col("n_nationkey").cast("long").alias("owner_id"))
    owned = supplier.select(F.explode(F.array(F.lit("user"), F.lit("team"))).alias("kind"), F.col("s_nationkey").cast("long").alias("owner_id"), F.col("s_suppkey").alias("crate_id"))
    return Registry(packages(spark, sf_dir), releases(spark, sf_dir), dependencies(spark, sf_dir), users.unionByName(teams), owned)


def dump_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The star-schema tables in the form of a registry dump, to be read by ``dump.registry_of``.

    Every seventh release is yanked, prereleases have identifiers of several kinds, requirements up to two comparators, every third
    line number renames its dependency, and features name the package itself, a dependency by its package's name and, weakly, one by its new name.
    """
    customer, supplier, nation, region, orders, lineitem = (_table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region", "orders", "lineitem"))
    key = F.col("o_orderkey")
    pre = F.element_at(F.array(*map(F.lit, PRERELEASES)), (F.expr("(o_orderkey div 4) % 6") + 1).cast("int"))
    num = F.concat_ws(".", key % 3, F.expr("(o_orderkey div 3) % 5"), F.expr("o_orderkey div 15"))
    to = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("other"), F.min(F.when(F.col("l_linenumber") == 3, F.col("l_suppkey"))).alias("renamed"))
    extra = F.concat(F.array(F.lit("std")), F.when(F.col("other").isNotNull(), F.array(F.concat(F.lit("c"), F.col("other").cast("string"), F.lit("/std")))).otherwise(F.array()),
                     F.when(F.col("renamed").isNotNull(), F.array(F.concat(F.lit("al"), F.col("renamed").cast("string"), F.lit("?/x")))).otherwise(F.array()))
    declared = F.to_json(F.create_map(F.lit("default"), F.array(F.lit("std")), F.lit("std"), F.array().cast("array<string>"), F.lit("extra"), extra))
    versions = orders.join(to, "o_orderkey", "left").select(
        key.alias("id"), F.col("o_custkey").alias("crate_id"), F.when((F.col("o_orderstatus") == "P") & (key % 4 == 0), F.concat_ws("-", num, pre)).otherwise(num).alias("num"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(key % 4 == 0, declared).otherwise("{}").alias("features"), F.when(key % 7 == 3, "t").otherwise("f").alias("yanked"),
    )
    rows = lineitem.withColumn("q", F.coalesce(F.floor("l_quantity"), F.lit(0)).cast("int")).select("l_orderkey", "l_suppkey", "l_linenumber", F.expr("q % 3").alias("a"), F.expr("q % 5").alias("b"), "l_returnflag", "l_linestatus", (F.col("l_tax") >= 0.04).alias("optional"), F.floor(F.col("l_discount") * 100 + 0.5).alias("cents")).distinct()
    text = F.expr("""CASE l_linenumber WHEN 1 THEN '*' WHEN 2 THEN concat(a, '.', b) WHEN 3 THEN concat('>=', a, '.', b, ', <', a + 1) WHEN 4 THEN concat('~', a, '.', b)
        WHEN 5 THEN concat('>', a, ',<=', a + 1, '.', b) WHEN 6 THEN concat('>=', a, '.', b, '.0-alpha.2') ELSE concat('=', a, '.', b) END""")
    dependencies = rows.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("version_id"), F.col("l_suppkey").alias("crate_id"), text.alias("req"), F.when(F.col("optional"), "t").otherwise("f").alias("optional"),
        F.when(F.col("cents") < 3, "t").otherwise("f").alias("default_features"), F.element_at(F.array(*map(F.lit, ("{}", "{extra}", "{default}", "{std,default,extra,std}"))), (F.col("cents") % 4 + 1).cast("int")).alias("features"),
        F.when(F.col("l_returnflag") != "N", 2).when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("kind"), F.when(F.col("l_linenumber") == 3, F.concat(F.lit("al"), F.col("l_suppkey").cast("string"))).alias("explicit_name"),
    )
    users = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("gh_login"))
    teams = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_nationkey").cast("long").alias("id"), F.concat(F.lit("github:"), F.regexp_replace("r_name", " ", "-"), F.lit(":"), "n_name").alias("login"))
    return {
        "crates": packages(spark, sf_dir).select(F.col("crate_id").alias("id"), "name"), "users": users, "teams": teams, "versions": versions, "dependencies": dependencies,
        "crate_owners": supplier.select(F.col("s_suppkey").alias("crate_id"), F.col("s_nationkey").cast("long").alias("owner_id"), (F.col("s_suppkey") % 2).cast("int").alias("owner_kind")),
    }

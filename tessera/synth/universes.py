"""Families of dependency universes as tables, made from row numbers and hashes: releases, requirements and roots.

Each function gives the three tables that tessera.operators.constraints describes, with a group column `universe`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.versions import version_range

Tables = tuple[DataFrame, DataFrame, DataFrame]


def _version(major: Column) -> Column:
    return F.struct(major.cast("long").alias("major"), F.lit(0).cast("long").alias("minor"), F.lit(0).cast("long").alias("patch"))


def _roots(universes: DataFrame, target: Column, spec: Column) -> DataFrame:
    return universes.select("universe", target.alias("target"), version_range(spec).alias("range"))


def chains(spark: SparkSession, n: int, length: int, versions: int) -> Tables:
    """n universes of packages p0 ... that each ask for the next one at their own version or below; the root asks for p0."""
    universes = spark.range(n).select(F.col("id").cast("int").alias("universe"))
    rows = universes.select("universe", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k")).select("universe", "k", F.explode(F.sequence(F.lit(1), F.lit(versions))).alias("x"))
    rows = rows.select("universe", "k", "x", F.concat(F.lit("p"), "k").alias("package"), _version(F.col("x")).alias("version"))
    asks = rows.where(F.col("k") < length - 1).select("universe", "package", "version", F.concat(F.lit("p"), F.col("k") + 1).alias("target"), version_range(F.format_string("<=%d.0.0", "x")).alias("range"), F.lit(0).alias("pos"))
    return rows.select("universe", "package", "version"), asks, _roots(universes, F.lit("p0"), F.lit("*"))


def exclusive(spark: SparkSession, n: int, sides: int) -> Tables:
    """n universes without a solution: `sides` packages ask for one more, each at a version of its own; all are roots."""
    universes = spark.range(n).select(F.col("id").cast("int").alias("universe"))
    rows = universes.select("universe", F.explode(F.sequence(F.lit(1), F.lit(sides))).alias("k"))
    one = _version(F.lit(1))
    releases = rows.select("universe", F.concat(F.lit("side"), "k").alias("package"), one.alias("version")).unionByName(rows.select("universe", F.lit("shared").alias("package"), _version(F.col("k")).alias("version")))
    asks = rows.select("universe", F.concat(F.lit("side"), "k").alias("package"), one.alias("version"), F.lit("shared").alias("target"), version_range(F.format_string("==%d.0.0", "k")).alias("range"), F.lit(0).alias("pos"))
    return releases, asks, _roots(rows, F.concat(F.lit("side"), "k"), F.lit("*"))


def random(spark: SparkSession, n: int, packages: int, versions: int, seed: int) -> Tables:
    """n universes in which a release asks, by a draw of its own, for up to two other packages from, up to or but for a version."""
    draw = lambda salt, m: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "universe", "k", "x"), F.lit(m)).cast("int")
    universes = spark.range(n).select(F.col("id").cast("int").alias("universe"))
    rows = universes.select("universe", F.explode(F.sequence(F.lit(0), F.lit(packages - 1))).alias("k")).select("universe", "k", F.explode(F.sequence(F.lit(1), F.lit(versions))).alias("x"))
    rows = rows.where((draw("there", 5) > 0) | (F.col("x") == 1)).select("universe", "k", "x", F.concat(F.lit("p"), "k").alias("package"), _version(F.col("x")).alias("version"))
    out = None
    for i in range(2):
        target = F.pmod(F.col("k") + 1 + draw(f"target{i}", max(packages - 1, 1)), F.lit(packages))
        spec = F.concat(F.element_at(F.array(*map(F.lit, (">=", "<=", "!="))), draw(f"op{i}", 3) + 1), (draw(f"bound{i}", versions) + 1).cast("string"), F.lit(".0.0"))
        part = rows.where(draw(f"asks{i}", 3) > 0).select("universe", "package", "version", F.concat(F.lit("p"), target).alias("target"), version_range(spec).alias("range"), F.lit(i).alias("pos"))
        out = part if out is None else out.unionByName(part)
    return rows.select("universe", "package", "version"), out, _roots(universes, F.lit("p0"), F.lit("*"))

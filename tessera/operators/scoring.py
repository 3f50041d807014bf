"""Scoring of checks: weighted categories, multipliers, partial credit, worst cases and bounds.

Checks have category, earned and possible; categories (category, weight) drive every join, so that a category
without checks counts with its full weight and no points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_fractions(checks: DataFrame, categories: DataFrame) -> DataFrame:
    """category, weight, checks, fraction: what a category earned of what it could, 0 if it has no checks."""
    sums = checks.groupBy("category").agg(F.sum("earned").alias("earned"), F.sum("possible").alias("possible"), F.count(F.lit(1)).alias("checks"))
    rows = categories.join(sums, "category", "left")
    fraction = F.when(F.col("possible") > 0, F.col("earned") / F.col("possible")).otherwise(0.0)
    return rows.select("category", "weight", F.coalesce("checks", F.lit(0)).alias("checks"), fraction.alias("fraction"))


def weighted(fractions: DataFrame) -> DataFrame:
    """score: the plain sum of weight times fraction."""
    return fractions.agg(F.sum(F.col("weight") * F.col("fraction")).alias("score"))


def weighted_with_multiplier(fractions: DataFrame, multiplier: str) -> DataFrame:
    """score, multiplier, all_green: the weighted mean of the categories but `multiplier`, times its fraction; a
    multiplier without checks makes the score 0."""
    is_it = F.col("category") == multiplier
    rows = fractions.agg(
        (F.sum(F.when(~is_it, F.col("weight") * F.col("fraction"))) / F.sum(F.when(~is_it, F.col("weight")))).alias("base"),
        F.coalesce(F.max(F.when(is_it, F.col("fraction"))), F.lit(0.0)).alias("multiplier"),
        F.bool_and(F.col("fraction") >= 1).alias("all_green"),
    )
    return rows.select((F.col("base") * F.col("multiplier")).alias("score"), "multiplier", "all_green")


def weighted_lenient(fractions: DataFrame, multiplier: str) -> DataFrame:
    """score: the sum of weight times fraction, not divided, times the multiplier's fraction or 1 without checks."""
    is_it = F.col("category") == multiplier
    factor = F.coalesce(F.max(F.when(is_it & (F.col("checks") > 0), F.col("fraction"))), F.lit(1.0))
    return fractions.agg((F.sum(F.when(~is_it, F.col("weight") * F.col("fraction"))) * factor).alias("score"))


def partial_credit(measured: Column, full_at: Column, zero_at: Column) -> Column:
    """1 at `full_at` and better, 0 at `zero_at` and worse, in between in proportion."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (zero_at - measured) / (zero_at - full_at)))


def worst(rows: DataFrame, name: str, value: str) -> DataFrame:
    """worst, at: the largest value and where it is; of equal ones the first name."""
    return rows.groupBy(value).agg(F.min(name).alias("__name")).agg(F.max(value).alias("worst"), F.max_by("__name", value).alias("at"))


def expansion_bound(size: Column) -> Column:
    """The size that encoding incompressible bytes may take."""
    return size + 64 + F.floor(size / 64).cast("long")


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """side and the columns of the rows that one side has more often, as often as it has them more."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))

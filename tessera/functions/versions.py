"""Ordered three-part versions and ranges over them, as column expressions.

A version is a struct (major, minor, patch) of longs, whose order is the struct's. A range is an array of structs
(op, version), all of which must hold; no comparator admits everything. Ranges are kept in one canonical form, sorted
without repeats, and two ranges are equal if their canonical forms are: equality is of syntax, not of what they admit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three numbers without leading zeros.
VERSION = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)$"
COMPARATOR = r"^(==|!=|>=|<=|>|<)\s*((?:0|[1-9][0-9]*)\.(?:0|[1-9][0-9]*)\.(?:0|[1-9][0-9]*))$"
PACKAGE = r"^[a-z][a-z0-9]*(-[a-z0-9]+)*$"


def version(text: Column) -> Column:
    """The version that a text denotes, or null if it denotes none."""
    part = lambda i: F.regexp_extract(text, VERSION, i).try_cast("long")
    return F.when(text.rlike(VERSION), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def version_text(v: Column) -> Column:
    """major.minor.patch."""
    return F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["patch"].cast("string"))


def version_range(text: Column) -> Column:
    """The canonical range of a text such as ">=1.0.0, <2.0.0", "*" or ""; null if a part of it is no comparator."""
    pieces = F.transform(F.split(text, ","), lambda p: F.trim(p))
    parsed = F.transform(pieces, lambda p: F.struct(version(F.regexp_extract(p, COMPARATOR, 2)).alias("version"), F.regexp_extract(p, COMPARATOR, 1).alias("op")))
    good = F.forall(pieces, lambda p: p.rlike(COMPARATOR))
    free = F.trim(text).isin("*", "")
    return F.when(free, F.slice(parsed, 1, 0)).when(good, F.array_sort(F.array_distinct(parsed)))


def contains(range_: Column, v: Column) -> Column:
    """Whether a version meets every comparator of a range."""
    return F.forall(
        range_,
        lambda c: F.when(c["op"] == "==", v == c["version"])
        .when(c["op"] == "!=", v != c["version"])
        .when(c["op"] == ">=", v >= c["version"])
        .when(c["op"] == "<=", v <= c["version"])
        .when(c["op"] == ">", v > c["version"])
        .otherwise(v < c["version"]),
    )


def range_text(range_: Column) -> Column:
    """The canonical text of a range, "*" if it admits everything."""
    joined = F.array_join(F.transform(range_, lambda c: F.concat(c["op"], version_text(c["version"]))), ",")
    return F.when(F.size(range_) == 0, "*").otherwise(joined)


def requirement(text: Column) -> Column:
    """The struct (package, range) of "name" or "name range"; null if the name or the range is none."""
    name = F.split(F.trim(text), r"\s+", 2)
    found = version_range(F.coalesce(F.get(name, F.lit(1)), F.lit("*")))
    return F.when(name[0].rlike(PACKAGE) & found.isNotNull(), F.struct(name[0].alias("package"), found.alias("range")))

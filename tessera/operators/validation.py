"""Rule-based validation of records: each rule is a column expression, each violation a row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A rule: severity ("error" or "warning"), the expression that holds where it is broken, its message.
Rules = Mapping[str, tuple[str, Column]]

#: Lower-case words joined by hyphens.
KEBAB = r"^[a-z0-9]+(-[a-z0-9]+)*$"
#: A share of a limit from which a warning is given.
NEAR = 0.9


def violations(rows: DataFrame, key: str, rules: Rules) -> DataFrame:
    """key, rule, severity of every rule that a row breaks; one pass over the rows, without a join."""
    found = [F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (severity, broken) in rules.items()]
    return rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("v")).select(key, "v.rule", "v.severity")


def rollup(rows: DataFrame, key: str, rules: Rules) -> DataFrame:
    """key, errors, warnings, status: FAIL with an error, else WARN with a warning, else OK."""
    count = lambda kind: sum((F.coalesce(broken, F.lit(False)).cast("int") for severity, broken in rules.values() if severity == kind), F.lit(0))
    counted = rows.select(key, count("error").alias("errors"), count("warning").alias("warnings"))
    status = F.when(F.col("errors") > 0, "FAIL").when(F.col("warnings") > 0, "WARN").otherwise("OK")
    return counted.withColumn("status", status)


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds, or null."""
    out = None
    for name, broken in reasons:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out


def length_rules(column: str, low: int, high: int) -> Rules:
    """Bounds of a text's length without the line ends after it, with a warning near the upper one."""
    size = F.length(F.rtrim(F.col(column), F.lit("\n")))
    return {
        f"{column}_short": ("error", size < low),
        f"{column}_long": ("error", size > high),
        f"{column}_near": ("warning", (size <= high) & (size >= int(high * NEAR))),
    }


def missing_required(required: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """What is required and not present."""
    return required.join(present, on, "left_anti")


def case_duplicates(rows: DataFrame, path: str) -> DataFrame:
    """lowered, spellings: paths that differ in case only."""
    return rows.groupBy(F.lower(path).alias("lowered")).agg(F.countDistinct(path).alias("spellings")).where("spellings > 1")


def unsafe_path(path: Column) -> Column:
    """Whether a path is absolute or steps up."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def shortest_cover(paths: DataFrame, path: str, required: list[str]) -> DataFrame:
    """prefix: the shortest folder (of equal depth the shortest name, then the first one) below which all required names are."""
    parts = F.split(path, "/")
    levels = paths.select(path, F.explode(F.sequence(F.lit(0), F.size(parts) - 1)).alias("depth"))
    cut = levels.select("depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("prefix"), F.array_join(F.slice(parts, F.col("depth") + 1, F.size(parts)), "/").alias("rest"))
    full = cut.where(F.col("rest").isin(required)).groupBy("depth", "prefix").agg(F.countDistinct("rest").alias("n")).where(F.col("n") == len(required))
    return full.agg(F.min_by("prefix", F.struct("depth", F.length("prefix"), "prefix")).alias("prefix"))


def repaired(paths: DataFrame, path: str, prefix: str, junk: list[str]) -> DataFrame:
    """Paths with the wrapper prefix stripped, without junk and folders."""
    rows = paths.where(~F.element_at(F.split(path, "/"), -1).isin(junk) & ~F.col(path).endswith("/"))
    cut = F.when(F.startswith(F.col(path), F.lit(f"{prefix}/")), F.substr(F.col(path), F.lit(len(prefix) + 2))).otherwise(F.col(path))
    return rows.withColumn("repaired", cut)


def artefact(path: Column, folders: list[str], parents: list[str], names: list[str], suffixes: list[str]) -> Column:
    """Whether a path is something that a run leaves behind: a part of it is in `folders`, a folder of it in `parents`, or its
    name is in `names` or ends in one of `suffixes`, the name being more than the suffix."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    listed = lambda words: F.array(*map(F.lit, words)).cast("array<string>")
    ends = F.lit(False)
    for suffix in suffixes:
        ends = ends | (F.endswith(name, F.lit(suffix)) & (F.length(name) > len(suffix)))
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(parts, listed(folders)) | F.arrays_overlap(above, listed(parents)) | F.array_contains(listed(names), name) | ends


def key_rules(keys: str, required: list[str], forbidden: list[str]) -> Rules:
    """Rules for a column of keys: each required one is there, no forbidden one is."""
    there = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    return {f"{k}_required": ("error", ~there(k)) for k in required} | {f"{k}_forbidden": ("error", there(k)) for k in forbidden}


def threshold_rule(column: str) -> Rules:
    """A threshold lies above 0 and is 1 at most; a missing one is no threshold."""
    value = F.col(column)
    return {f"{column}_threshold": ("error", ~F.coalesce((value > 0) & (value <= 1), F.lit(False)))}


#: What a scan of identifiers cuts a text into: comments and quoted strings first, then words, then all else, one piece after the other.
LEXEMES = r"""(?s)<!--.*?-->|/\*.*?\*/|"[^"\n]*"|'[^'\n]*'|[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_<"'/]+|."""
WORD = "^[A-Za-z_][A-Za-z0-9_]*$"


def identifiers(rows: DataFrame, key: str, text: str, allowed: DataFrame | None = None) -> DataFrame:
    """key, start, word: the words of each text outside of comments and strings, with their places from 1, but for `allowed` (word).

    One expression cuts a text into lexemes from left to right, so a quote inside a comment, or a comment's sign inside a
    string, opens nothing; an open comment or quote without an end is a character like others. Lexemes lose no
    character, so a running sum of their lengths, inside the text, gives the places.
    """
    pieces = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(LEXEMES), F.lit(0))).alias("__at", "word"))
    before = Window.partitionBy(key).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    words = pieces.withColumn("start", (F.coalesce(F.sum(F.length("word")).over(before), F.lit(0)) + 1).cast("long")).where(F.col("word").rlike(WORD))
    words = words.select(key, "start", "word")
    return words if allowed is None else words.join(allowed.select("word"), "word", "left_anti").select(key, "start", "word")


def content_hash(column: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(column, 256), 1, 16)


def stale(rendered: DataFrame, stored: DataFrame, key: str, text: str) -> DataFrame:
    """key, state of the records whose stored text is not what rendering gives now: stale, missing or left over."""
    now, kept = rendered.select(key, F.struct(text).alias("__now")), stored.select(key, F.struct(text).alias("__kept"))
    both = now.join(kept, key, "full_outer").where(~F.col("__now").eqNullSafe(F.col("__kept")))
    state = F.when(F.col("__kept").isNull(), "missing").when(F.col("__now").isNull(), "left over").otherwise("stale")
    return both.select(key, state.alias("state"))

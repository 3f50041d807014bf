"""Seeded telemetry records, made by the executors from a row number and hashes of it: no state, any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words that records draw from, and the levels with their weights.
HOSTS = ["web-1", "web-2", "db-1", "db-2", "cache-1", "edge-7"]
SERVICES = ["auth", "billing", "search", "ingest", "mail"]
LEVELS = [("info", 12), ("warn", 3), ("error", 1), ("debug", 1)]
PHRASES = ["request served", "cache miss", "retrying upstream", "connection closed", "slow query", "token refreshed"]


def draw(seed: int, salt: str, n: int) -> Column:
    """A number from 0 to n - 1 that depends on the row, the seed and the salt."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n)).cast("int")


def pick(seed: int, salt: str, words: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), draw(seed, salt, len(words)) + 1)


def records(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, ts (milliseconds), host, svc, lvl, value, count, tag, msg."""
    levels = [name for name, weight in LEVELS for _ in range(weight)]
    rows = spark.range(n)
    return rows.select(
        "id", (F.lit(1_700_000_000_000) + F.col("id") * 250 + draw(seed, "ts", 250)).alias("ts"), pick(seed, "host", HOSTS).alias("host"), pick(seed, "svc", SERVICES).alias("svc"),
        pick(seed, "lvl", levels).alias("lvl"), (draw(seed, "value", 1_000_000) / 10_000).alias("value"), draw(seed, "count", 500).alias("count"), F.concat(F.lit("t"), draw(seed, "tag", 40)).alias("tag"), pick(seed, "msg", PHRASES).alias("msg"),
    )


def logfmt(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, line in logfmt, with one to four keys of its own."""
    r = records(spark, n, seed)
    more = [F.when(draw(seed, "keys", 4) >= k, F.format_string(f" k{k}=%.3f", F.col("value") * (k + 1))).otherwise("") for k in range(4)]
    return r.select("id", F.concat(F.format_string('ts=%d.%03d host=%s svc=%s lvl=%s', F.floor(F.col("ts") / 1000), F.col("ts") % 1000, "host", "svc", "lvl"), *more, F.format_string(' msg="%s"', "msg")).alias("line"))


def csv(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, line of ts,series,value,count,tag."""
    return records(spark, n, seed).select("id", F.format_string("%d,%s.%s,%.4f,%d,%s", "ts", "host", "svc", "value", "count", "tag").alias("line"))


def jsonl(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, line of a JSON object with a map and an array."""
    r = records(spark, n, seed)
    tags = F.slice(F.array("tag", "lvl", "svc"), F.lit(1), draw(seed, "tags", 3) + 1)
    return r.select("id", F.to_json(F.struct("ts", F.col("host").alias("h"), F.col("svc").alias("s"), "lvl", F.create_map(F.lit("v"), "value", F.lit("c"), F.col("count").cast("double")).alias("m"), tags.alias("tg"))).alias("line"))


def opaque(spark: SparkSession, n: int, seed: int, width: int = 76) -> DataFrame:
    """id, line of characters that look random."""
    digits = F.concat(*(F.sha2(F.concat(F.lit(f"{seed}/{k}/"), F.col("id")), 512) for k in range(1 + width // 80)))
    return spark.range(n).select("id", F.substring(F.base64(F.unhex(digits)), 1, width).alias("line"))


def binlog(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, payload of a marker, a time, host and service numbers and a little-endian count."""
    r = records(spark, n, seed)
    number = F.lpad(F.hex("count"), 8, "0")
    little = F.concat(*(F.substring(number, 7 - 2 * k, 2) for k in range(4)))
    return r.select("id", F.unhex(F.concat(F.lit("9E5A"), F.lpad(F.hex("ts"), 16, "0"), F.lpad(F.hex(draw(seed, "host", len(HOSTS))), 2, "0"), F.lpad(F.hex(draw(seed, "svc", len(SERVICES))), 2, "0"), little)).alias("payload"))


def random(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, line of 64 hex digits, no two alike."""
    return spark.range(n).select("id", F.sha2(F.concat(F.lit(f"{seed}/"), F.col("id")).cast("binary"), 256).alias("line"))


def repeated(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, one line over and over."""
    line = logfmt(spark, 1, seed).select("line")
    return spark.range(n).join(F.broadcast(line))


def cycle(spark: SparkSession, n: int, seed: int, period: int = 7) -> DataFrame:
    """id, the first `period` lines of logfmt in turn."""
    lines = logfmt(spark, period, seed).select(F.col("id").alias("of"), "line")
    return spark.range(n).join(F.broadcast(lines), F.col("id") % period == F.col("of")).select("id", "line")


def mixed(spark: SparkSession, n: int, seed: int, run: int = 64) -> DataFrame:
    """id, lines of logfmt, csv, jsonl and opaque in runs of `run`."""
    out, makes = None, (logfmt, csv, jsonl, opaque)
    for k, make in enumerate(makes):
        part = make(spark, n, seed).where(F.floor(F.col("id") / run) % len(makes) == k)
        out = part if out is None else out.unionByName(part)
    return out


def edge(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """id, lines at the edges: empty, one byte, all bytes' worth of blanks, a long one, and letters of several bytes."""
    long = F.repeat(F.lit("ab"), draw(seed, "long", 4096))
    kinds = [F.lit(""), F.lit("x"), F.lit(" " * 256), long, F.lit("é日本")]
    return spark.range(n).select("id", F.element_at(F.array(*kinds), (F.col("id") % len(kinds) + 1).cast("int")).alias("line"))


PROFILES = {"logfmt": logfmt, "csv": csv, "jsonl": jsonl, "opaque": opaque, "random": random, "repeated": repeated, "cycle": cycle, "mixed": mixed, "edge": edge}

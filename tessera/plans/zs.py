"""Queries of byte statistics, codes and the codec, over the texts of `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bytes_stats as zs
from tessera.plans.registry import register
from tessera.sources.tables import table

BYTES = """
WITH RECURSIVE d AS (SELECT doc_id, lang, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, lang, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER) AS byte FROM (SELECT *, unnest(range(0, length(h) // 2)) AS i FROM d))
"""


@register("zs_byte_histogram", BYTES + "SELECT byte, count(*) AS n FROM b GROUP BY byte")
def zs_byte_histogram(spark, sf_dir):
    return zs.byte_histogram(table(spark, sf_dir, "documents"), "text")


@register("zs_context_counts", BYTES + "SELECT CAST(coalesce(before, 0) >> 6 AS INTEGER) AS context, byte, count(*) * 16 AS n FROM (SELECT byte, lag(byte) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM b) GROUP BY 1, 2")
def zs_context_counts(spark, sf_dir):
    return zs.context_counts(table(spark, sf_dir, "documents"), "text")


@register("zs_entropy_bound", BYTES + """
, h AS (SELECT lang, byte, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS bytes FROM h GROUP BY lang)
SELECT lang, bytes, round(sum(-n * log2(n / bytes)) / 8, 2) AS bound FROM h JOIN t USING (lang) GROUP BY lang, bytes""")
def zs_entropy_bound(spark, sf_dir):
    rows = zs.entropy_bytes(zs.byte_histogram(table(spark, sf_dir, "documents"), "text", "lang"), "lang")
    return rows.withColumn("bound", F.round("bound", 2))


@register("zs_huffman_size")
def zs_huffman_size(spark, sf_dir):
    return zs.huffman_sizes(zs.byte_histogram(table(spark, sf_dir, "documents"), "text", "lang"), "lang")


@register("zs_varint_length", "SELECT o_orderkey, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS bytes FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (o_orderkey % 5) AS v FROM orders)")
def zs_varint_length(spark, sf_dir):
    value = F.round(F.col("o_totalprice") * 100).cast("long") * (F.col("o_orderkey") % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", zs.varint_length(value).alias("bytes"))


@register("zs_varint_bytes", """
SELECT o_orderkey, array_to_string(list_transform(range(n), lambda i : printf('%02X', ((v >> (7 * i)::INT) & 127) | CASE WHEN i < n - 1 THEN 128 ELSE 0 END)), '') AS bytes
FROM (SELECT o_orderkey, v, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 ELSE 5 END AS n FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * (o_orderkey % 5) AS v FROM orders))""")
def zs_varint_bytes(spark, sf_dir):
    value = F.round(F.col("o_totalprice") * 100).cast("long") * (F.col("o_orderkey") % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("v")).select("o_orderkey", zs.varint_hex(F.col("v")).alias("bytes"))


#: The first length and the first distance of each code.
LENGTH_BASE = [3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 19, 23, 27, 31, 35, 43, 51, 59, 67, 83, 99, 115, 131, 163, 195, 227, 258]
DISTANCE_BASE = [1, 2, 3, 4, 5, 7, 9, 13, 17, 25, 33, 49, 65, 97, 129, 193, 257, 385, 513, 769, 1025, 1537, 2049, 3073, 4097, 6145]


@register("zs_match_codes", f"""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(len(list_filter({LENGTH_BASE}, lambda x: x <= v)) - 1 AS INTEGER) AS length_code, CAST(v - list_max(list_filter({LENGTH_BASE}, lambda x: x <= v)) AS BIGINT) AS length_extra,
  CAST(len(list_filter({DISTANCE_BASE}, lambda x: x <= d)) - 1 AS INTEGER) AS distance_code, CAST(d - list_max(list_filter({DISTANCE_BASE}, lambda x: x <= d)) AS BIGINT) AS distance_extra
FROM (SELECT l_orderkey, l_linenumber, l_partkey, 4 + l_orderkey % 255 AS v, 1 + (l_orderkey * 7 + l_partkey) % 8192 AS d FROM lineitem)""")
def zs_match_codes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    code, extra = zs.bucket(4 + F.col("l_orderkey") % 255, LENGTH_BASE)
    far, far_extra = zs.bucket(1 + (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 8192, DISTANCE_BASE)
    return lines.select("*", code.alias("length_code"), extra.alias("length_extra"), far.alias("distance_code"), far_extra.alias("distance_extra"))


@register("zs_roundtrip", "SELECT doc_id, strlen(text) AS bytes, sha256(text) AS digest, true AS same FROM documents")
def zs_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    back = docs.withColumn("back", zs.decompress_column(zs.compress_column(F.col("raw"))))
    return back.select("doc_id", F.octet_length("raw").cast("long").alias("bytes"), F.sha2("back", 256).alias("digest"), F.col("raw").eqNullSafe(F.col("back")).alias("same"))


@register("zs_ratio")
def zs_ratio(spark, sf_dir):
    """By language: bytes, coded bytes and whether every frame is within the bound on expansion."""
    from tessera.operators.scoring import expansion_bound

    docs = table(spark, sf_dir, "documents").select("lang", F.octet_length("text").cast("long").alias("n"), F.octet_length(zs.compress_column(F.col("text"))).cast("long").alias("coded"))
    return docs.groupBy("lang").agg(F.sum("n").alias("bytes"), F.sum("coded").alias("coded"), F.bool_and(F.col("coded") <= expansion_bound(F.col("n"))).alias("within"))


@register("cg_telemetry_profiles")
def cg_telemetry_profiles(spark, sf_dir):
    """profile, lines, bytes of each generated profile, with as many records as there are events."""
    from tessera.synth import telemetry

    n, out = table(spark, sf_dir, "events").count(), None
    for name, make in telemetry.PROFILES.items():
        part = make(spark, n, 42).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line").cast("long") + 1).alias("bytes")).select(F.lit(name).alias("profile"), "lines", "bytes")
        out = part if out is None else out.unionByName(part)
    return out

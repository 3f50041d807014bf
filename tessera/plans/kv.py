"""Queries of the versioned store, with `events` as its log: each event writes its user's value, an error deletes it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import versioned as kv
from tessera.operators.numbering import numbered
from tessera.plans.registry import register
from tessera.sources.tables import table

#: The log in DuckDB.
LOG = """
WITH log AS (
  SELECT user_id AS key, row_number() OVER (ORDER BY ts, event_id) AS version,
         value, event_type = 'error' AS is_delete, event_id, event_type
  FROM events
), n AS (SELECT count(*) AS n FROM events)
"""
NEWEST = "row_number() OVER (PARTITION BY key ORDER BY version DESC)"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, version, value, is_delete, event_id."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    rows = numbered(events, "version", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"), ["event_id"])
    return rows.select(F.col("user_id").alias("key"), "version", "value", (F.col("event_type") == "error").alias("is_delete"), "event_id", "event_type")


def _half(log: DataFrame):
    return log.count() // 2


@register("kv_latest", LOG + f"SELECT key, version, value FROM (SELECT *, {NEWEST} AS r FROM log) WHERE r = 1 AND NOT is_delete")
def kv_latest(spark, sf_dir):
    return kv.latest(event_log(spark, sf_dir))


@register("kv_snapshot_scan", LOG + f"SELECT key, version, value FROM (SELECT log.*, {NEWEST} AS r FROM log, n WHERE version <= n // 2) WHERE r = 1 AND NOT is_delete")
def kv_snapshot_scan(spark, sf_dir):
    half = table(spark, sf_dir, "events").count() // 2
    return kv.latest(event_log(spark, sf_dir), half)


@register("kv_snapshot_get", LOG + f"""
SELECT a.key, s.value FROM (SELECT unnest([1, 7, 42, 99, 100000]) AS key) a LEFT JOIN (
  SELECT key, value FROM (SELECT log.*, {NEWEST} AS r FROM log, n WHERE version <= n // 2) WHERE r = 1 AND NOT is_delete) s USING (key)""")
def kv_snapshot_get(spark, sf_dir):
    half = table(spark, sf_dir, "events").count() // 2
    return kv.get_many(event_log(spark, sf_dir), [1, 7, 42, 99, 100000], half)


@register("kv_prefix_scan", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000000%' ORDER BY c_name")
def kv_prefix_scan(spark, sf_dir):
    return kv.prefix_scan(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "Customer#0000000")


@register("kv_overlay_scan", LOG + f"""
, base AS (SELECT key, value FROM (SELECT log.*, {NEWEST} AS r FROM log, n WHERE version <= n // 2) WHERE r = 1 AND NOT is_delete),
own AS (SELECT key, value, is_delete FROM (SELECT log.*, {NEWEST} AS r FROM log, n WHERE version > n - n // 50) WHERE r = 1)
SELECT coalesce(own.key, base.key) AS key, CASE WHEN own.key IS NOT NULL THEN own.value ELSE base.value END AS value
FROM base FULL OUTER JOIN own ON base.key = own.key WHERE own.key IS NULL OR NOT own.is_delete""")
def kv_overlay_scan(spark, sf_dir):
    log = event_log(spark, sf_dir)
    n = table(spark, sf_dir, "events").count()
    return kv.overlay(kv.latest(log, n // 2), kv.state_at(log.where(F.col("version") > n - n // 50)))


TXNS = """
WITH t AS (
  SELECT o_orderkey AS txn, o_custkey AS key,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS commit,
         greatest(0, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 - o_orderkey % 4) AS begin
  FROM orders
)
"""


def order_txns(spark, sf_dir):
    """A transaction for each order: it writes its customer's key; its commit is the order's place among the
    customer's, and its begin 1 to 4 places earlier."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long")
    rows = orders.select(F.col("o_orderkey").alias("txn"), F.col("o_custkey").alias("key"), place.alias("commit"))
    return rows.withColumn("begin", F.greatest(F.lit(0).cast("long"), F.col("commit") - 1 - F.col("txn") % 4))


@register("kv_conflicts_pairwise", TXNS + "SELECT DISTINCT a.txn, b.txn AS other, a.key FROM t a JOIN t b ON a.key = b.key AND b.commit > a.begin AND b.commit < a.commit AND a.txn <> b.txn")
def kv_conflicts_pairwise(spark, sf_dir):
    return kv.conflicts_pairwise(order_txns(spark, sf_dir))


WRITE_SETS = TXNS.replace("WITH t", "WITH RECURSIVE t") + """
, w AS (SELECT t.txn, t.key AS part, t.commit, t.begin, list(DISTINCT l_linenumber) AS keys FROM t JOIN lineitem ON l_orderkey = t.txn GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY commit) AS nth FROM w),
f AS (
  SELECT part, txn, nth, true AS committed, [CASE WHEN list_contains(keys, x) THEN commit ELSE 0 END FOR x IN range(1, 8)] AS last FROM o WHERE nth = 1
  UNION ALL
  SELECT part, txn, nth, ok, CASE WHEN ok THEN [CASE WHEN list_contains(keys, x) THEN commit ELSE last[x] END FOR x IN range(1, 8)] ELSE last END
  FROM (SELECT o.*, f.last, list_max([f.last[x] FOR x IN o.keys]) <= o.begin AS ok FROM f JOIN o ON o.part = f.part AND o.nth = f.nth + 1)
) SELECT part, txn, committed FROM f"""


@register("kv_commit_fold", WRITE_SETS)
def kv_commit_fold(spark, sf_dir):
    """A transaction for each order with lines: it writes the line numbers (up to 7 keys) of its customer, who is the part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    rows = order_txns(spark, sf_dir).withColumnRenamed("key", "part").join(lines, F.col("txn") == F.col("l_orderkey"))
    return kv.commit_fold(rows.select("part", "txn", F.col("l_linenumber").alias("key"), "begin", "commit"), "part")


@register("kv_commit_rounds", """
WITH RECURSIVE t AS (SELECT o_orderkey AS txn, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS commit FROM orders),
w AS (SELECT txn, commit, greatest(0, commit - 1 - txn % 8) AS begin, l_partkey AS key FROM t JOIN lineitem ON l_orderkey = txn GROUP BY ALL),
rivals AS (SELECT DISTINCT a.txn, b.txn AS other FROM w a JOIN w b ON a.key = b.key AND b.commit > a.begin AND b.commit < a.commit),
o AS (SELECT txn, row_number() OVER (ORDER BY commit) AS nth FROM (SELECT DISTINCT txn, commit FROM w)),
r AS (SELECT o.txn, o.nth, coalesce(list(p.nth) FILTER (p.nth IS NOT NULL), []) AS before FROM o LEFT JOIN rivals ON rivals.txn = o.txn LEFT JOIN o p ON p.txn = rivals.other GROUP BY ALL),
lone AS (SELECT txn FROM r WHERE len(before) = 0),
deep AS (SELECT txn, before, row_number() OVER (ORDER BY nth) AS step, nth FROM r WHERE len(before) > 0),
f AS (SELECT 0::BIGINT AS step, []::BIGINT[] AS failed, NULL::BIGINT AS txn, NULL::BOOLEAN AS committed
  UNION ALL
  SELECT deep.step, CASE WHEN len(list_filter(before, lambda x : NOT list_contains(failed, x))) > 0 THEN list_append(failed, deep.nth) ELSE failed END, deep.txn, len(list_filter(before, lambda x : NOT list_contains(failed, x))) = 0
  FROM f JOIN deep ON deep.step = f.step + 1)
SELECT 0::BIGINT AS part, txn, true AS committed FROM lone UNION ALL SELECT 0, txn, committed FROM f WHERE txn IS NOT NULL""")
def kv_commit_rounds(spark, sf_dir):
    """One group of all orders: a transaction writes the parts of its lines, and began up to 8 commits before its own."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    at = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    txns = numbered(orders.withColumnRenamed("o_orderkey", "txn"), "commit", at, ["txn"])
    txns = txns.withColumn("begin", F.greatest(F.lit(0).cast("long"), F.col("commit") - 1 - F.col("txn") % 8))
    rows = txns.join(lines, txns.txn == lines.l_orderkey).select(F.lit(0).cast("long").alias("part"), "txn", F.col("l_partkey").alias("key"), "begin", "commit")
    return kv.commit_rounds(rows, "part")


@register("kv_asof_join", LOG + """
, q AS (SELECT event_id, key, version - 1 AS at FROM log WHERE event_type IN ('click', 'error'))
SELECT q.event_id, q.key, q.at, CASE WHEN NOT l.is_delete THEN l.version END AS found_version, CASE WHEN NOT l.is_delete THEN l.value END AS value
FROM q ASOF LEFT JOIN log l ON q.key = l.key AND q.at >= l.version""")
def kv_asof_join(spark, sf_dir):
    """For each click and error, what its user's key had just before: every row asks at a version of its own."""
    log = event_log(spark, sf_dir)
    asked = log.where("event_type IN ('click', 'error')").select("event_id", "key", (F.col("version") - 1).alias("at"))
    return kv.asof_join(asked, log.select("key", "version", "value", "is_delete"))


@register("kv_prune_versions", LOG + """
, c AS (SELECT log.*, lead(version) OVER (PARTITION BY key ORDER BY version) AS nxt, n // 2 AS h FROM log, n),
k AS (SELECT *, count(*) OVER (PARTITION BY key) AS left_over FROM c WHERE nxt IS NULL OR nxt > h)
SELECT key, version, value, is_delete FROM k WHERE NOT (left_over = 1 AND is_delete AND version <= h)""")
def kv_prune_versions(spark, sf_dir):
    half = table(spark, sf_dir, "events").count() // 2
    return kv.prune(event_log(spark, sf_dir), half).select("key", "version", "value", "is_delete")


@register("kv_checkpoint_contents", LOG + f"SELECT key, version, value FROM (SELECT *, {NEWEST} AS r FROM log) WHERE r = 1 AND NOT is_delete ORDER BY key")
def kv_checkpoint_contents(spark, sf_dir):
    log = event_log(spark, sf_dir)
    half = table(spark, sf_dir, "events").count() // 2
    early = kv.state_at(log, half)
    return kv.replay(early, log.select(*early.columns), half).orderBy("key")


@register("kv_stats", LOG + f"""
, live AS (SELECT * FROM (SELECT *, {NEWEST} AS r FROM log) WHERE r = 1 AND NOT is_delete)
SELECT max(version) AS commit_version, CAST(sum(length(CAST(key AS VARCHAR)) + length(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR))) AS BIGINT) AS log_bytes,
  (SELECT count(*) FROM live) AS live_keys,
  (SELECT CAST(sum(length(CAST(key AS VARCHAR)) + length(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR))) AS BIGINT) FROM live) AS live_bytes,
  sum(length(CAST(key AS VARCHAR)) + length(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR))) <= 4 * (SELECT sum(length(CAST(key AS VARCHAR)) + length(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR))) FROM live) + 65536 AS within_bound
FROM log""")
def kv_stats(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return kv.stats(log)


@register("kv_recover_prefix", LOG + """
, f AS (SELECT *, event_id % 997 <> 500 AS ok FROM log), b AS (SELECT min(version) FILTER (NOT ok) AS bad FROM f)
SELECT key, version, value, is_delete FROM f, b WHERE bad IS NULL OR version < bad""")
def kv_recover_prefix(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("ok", F.col("event_id") % 997 != 500)
    return kv.valid_prefix(log).select("key", "version", "value", "is_delete")


@register("kv_delete_existed", LOG + """
SELECT key, version, coalesce(NOT before, false) AS existed FROM (
  SELECT *, lag(is_delete) OVER (PARTITION BY key ORDER BY version) AS before FROM log) WHERE is_delete""")
def kv_delete_existed(spark, sf_dir):
    return kv.delete_existed(event_log(spark, sf_dir))


@register("kv_invalid_entries", """
SELECT doc_id, CASE WHEN source IS NULL OR strlen(source) < 1 THEN 'empty_key' WHEN strlen(source) > 4096 THEN 'long_key' ELSE 'long_value' END AS reason
FROM (SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 50 = 1 THEN repeat(source, 2000) ELSE source END AS source FROM documents)
WHERE strlen(source) < 1 OR strlen(source) > 4096""")
def kv_invalid_entries(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = F.expr("CASE WHEN doc_id % 50 = 0 THEN '' WHEN doc_id % 50 = 1 THEN repeat(source, 2000) ELSE source END")
    return kv.invalid_entries(docs.select("doc_id", key.alias("key"), F.lit("v").alias("value"))).select("doc_id", "reason")


@register("kv_crc_verify")
def kv_crc_verify(spark, sf_dir):
    """doc_id, crc, ok: the checksum of each text against one that a byte has been changed in for some rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("body"))
    kept = F.crc32("body")
    read = F.when(F.col("doc_id") % 7 == 3, F.concat(F.col("body"), F.lit(b"!"))).otherwise(F.col("body"))
    return docs.select("doc_id", kept.alias("crc"), (F.crc32(read) == kept).alias("ok"))

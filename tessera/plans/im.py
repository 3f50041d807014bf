"""Queries of incremental computation: `events` sets inputs (user -> event type), orders and line items are a rollup."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import dataflow
from tessera.operators import incremental as im
from tessera.operators.lineage import cut, shared_root
from tessera.operators.numbering import numbered
from tessera.operators.traces import Traces
from tessera.plans.kv import event_log
from tessera.plans.registry import register
from tessera.sources.tables import table
from tessera.streaming.views import IncrementalView

STEPS = """
WITH w AS (SELECT user_id AS key, event_type AS value, row_number() OVER (ORDER BY ts, event_id) AS version FROM events),
c AS (SELECT *, value IS DISTINCT FROM lag(value) OVER (PARTITION BY key ORDER BY version) AS changed FROM w),
r AS (SELECT *, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (ORDER BY version) AS BIGINT) AS revision FROM c),
s AS (SELECT *, max(CASE WHEN changed THEN revision END) OVER (PARTITION BY key ORDER BY version) AS changed_at FROM r)
"""


def _writes(spark, sf_dir):
    return event_log(spark, sf_dir).select("key", "version", F.col("event_type").alias("value"))


@register("im_revisions", STEPS + "SELECT key, version, value, changed, revision FROM s")
def im_revisions(spark, sf_dir):
    return im.revisions(_writes(spark, sf_dir)).drop("changed_at")


@register("im_noop_suppressed", STEPS + "SELECT key, count(*) AS writes, count(*) FILTER (NOT changed) AS suppressed FROM s GROUP BY key")
def im_noop_suppressed(spark, sf_dir):
    rows = im.changes(_writes(spark, sf_dir))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("writes"), F.count_if(~F.col("changed")).alias("suppressed"))


@register("im_changed_at", STEPS + "SELECT key, version, changed_at FROM s")
def im_changed_at(spark, sf_dir):
    return im.revisions(_writes(spark, sf_dir)).select("key", "version", "changed_at")


@register("im_stats", STEPS + "SELECT count(*) AS writes, max(revision) AS revision, count(DISTINCT key) AS inputs FROM s")
def im_stats(spark, sf_dir):
    rows = im.revisions(_writes(spark, sf_dir))
    return rows.agg(F.count(F.lit(1)).alias("writes"), F.max("revision").alias("revision"), F.countDistinct("key").alias("inputs"))


@register("im_execution_counts", "SELECT event_type, user_id, count(*) AS executions FROM events GROUP BY event_type, user_id")
def im_execution_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("executions"))


@register("im_first_changed_dep", """
SELECT l_orderkey AS node, min_by(l_partkey, l_linenumber * 100000000 + l_partkey) AS dep FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY GROUP BY l_orderkey""")
def im_first_changed_dep(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    deps = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("node"), (F.col("l_linenumber").cast("long") * 100000000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("dep"),
        F.col("l_shipdate").alias("changed_at"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("verified_at"))
    return im.first_changed_dependency(deps)


SLICE = "l_shipdate >= TIMESTAMP '1998-03-01' AND l_shipdate < TIMESTAMP '1998-03-08'"
SPARK_SLICE = "l_shipdate >= TIMESTAMP_NTZ '1998-03-01 00:00:00' AND l_shipdate < TIMESTAMP_NTZ '1998-03-08 00:00:00'"


def _changed_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(SPARK_SLICE)


@register("im_affected_groups", f"""
WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE {SLICE}), c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey IN (SELECT k FROM o)),
n AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_custkey IN (SELECT k FROM c))
SELECT 'order' AS level, k AS node FROM o UNION ALL SELECT 'customer', k FROM c UNION ALL SELECT 'nation', k FROM n""")
def im_affected_groups(spark, sf_dir):
    orders = _changed_lines(spark, sf_dir).select("l_orderkey").distinct()
    up = [(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey"), (table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")]
    customers, nations = im.affected(orders, up)
    named = lambda df, level: df.select(F.lit(level).alias("level"), F.col(df.columns[0]).cast("long").alias("node"))
    return named(orders, "order").unionByName(named(customers, "customer")).unionByName(named(nations, "nation"))


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


@register("im_rollup_incremental", f"""
SELECT c_nationkey AS nation, CAST(sum({CENTS} * CASE WHEN {SLICE} THEN 2 ELSE 1 END) AS BIGINT) AS cents
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey""")
def im_rollup_incremental(spark, sf_dir):
    """The lines of the slice count twice: totals by nation are kept as a stored view, which all lines make once and the slice's
    lines then move on; the second version reads the first one and the slice, not the lines before."""
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")

    def batch(lines):
        rows = lines.select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents")).groupBy("l_orderkey").agg(F.sum("cents").alias("cents"))
        rows = rows.join(orders, rows.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        return rows.select(F.col("c_nationkey").cast("string").alias("group"), "cents")

    view = IncrementalView(f"{shared_root(spark)}/rollup-{uuid.uuid4().hex}")
    view.apply(batch(table(spark, sf_dir, "lineitem")), 1)
    view.apply(batch(_changed_lines(spark, sf_dir)), 2)
    return view.read(spark, 2).select(F.col("group").cast("long").alias("nation"), "cents")


@register("im_early_cutoff", f"""
WITH t AS (SELECT l_orderkey AS node, CAST(sum({CENTS}) AS BIGINT) // 1000000 AS old, CAST(sum({CENTS} + CASE WHEN {SLICE} THEN 30000 ELSE 0 END) AS BIGINT) // 1000000 AS value FROM lineitem GROUP BY 1)
SELECT node, value FROM t WHERE old <> value""")
def im_early_cutoff(spark, sf_dir):
    """Orders whose total, in steps of 10 000, is another one after 300 more for each line of the slice; only affected orders are recomputed."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), "l_shipdate")
    touched = lines.where(SPARK_SLICE).select("l_orderkey").distinct()
    mine = lines.join(touched, "l_orderkey", "left_semi")
    step = lambda c: F.expr(f"sum({c}) div 1000000").alias("value")
    old = mine.groupBy(F.col("l_orderkey").alias("node")).agg(step("cents"))
    new = mine.groupBy(F.col("l_orderkey").alias("node")).agg(step(f"cents + IF({SPARK_SLICE}, 30000L, 0L)"))
    return im.cutoff(old, new, "node", "value")


@register("im_hierarchical_rollup", """
WITH m AS (SELECT event_id // 10 AS node, sum(CAST(round(value * 100) AS BIGINT)) AS t FROM events GROUP BY 1), tops AS (SELECT node // 10 AS node, sum(t) AS t FROM m GROUP BY 1),
root AS (SELECT node // 10 AS node, sum(t) AS t FROM tops GROUP BY 1)
SELECT 1 AS level, node, CAST(t AS BIGINT) AS total FROM m UNION ALL SELECT 2, node, CAST(t AS BIGINT) FROM tops UNION ALL SELECT 3, node, CAST(t AS BIGINT) FROM root""")
def im_hierarchical_rollup(spark, sf_dir):
    return im.hierarchy(table(spark, sf_dir, "events"), "event_id", F.round(F.col("value") * 100).cast("long"), 10, 3)


@register("im_drop_dangling", """
WITH RECURSIVE n AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 40 NOT IN (21, 39)), e AS (SELECT o_orderkey AS node, o_orderkey + 1 AS dep FROM orders WHERE o_orderkey % 8 <> 7 AND o_orderkey % 40 NOT IN (21, 39)
  UNION ALL SELECT o_orderkey, o_orderkey - 8 FROM orders WHERE o_orderkey % 16 = 8),
bad AS (SELECT node FROM e WHERE dep NOT IN (SELECT node FROM n) UNION SELECT e.node FROM e JOIN bad ON e.dep = bad.node) SELECT node FROM n WHERE node NOT IN (SELECT node FROM bad)""")
def im_drop_dangling(spark, sf_dir):
    """Orders in chains of eight, some chains on others; what rests, over any number of steps, on a missing order goes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"))
    nodes = orders.where("node % 40 NOT IN (21, 39)")
    edges = nodes.where("node % 8 <> 7").select("node", (F.col("node") + 1).alias("dep")).unionByName(orders.where("node % 16 = 8").select("node", (F.col("node") - 8).alias("dep")))
    return im.drop_dangling(edges, nodes)


def _rollup_body():
    """Bodies of the rollup: a customer (kind sum) adds its orders in thousands, a nation (kind sum) its customers; a choice
    (kind cond) reads its nation and, if that is even, the next one."""
    none, total = F.array().cast("array<long>"), F.aggregate("read", F.lit(0).cast("long"), lambda a, r: a + r.value)
    first, even = F.size("read") == 0, F.get("read", F.lit(0))["value"] % 2 == 0
    more = F.when(first, F.slice("args", 1, 1)).when((F.size("read") == 1) & even, F.slice("args", 2, 1)).otherwise(none)
    wants = F.when(F.col("kind") == "cond", more).otherwise(F.when(first, F.col("args")).otherwise(none))
    value = F.when(F.col("kind") == "cond", F.try_element_at("read", F.lit(-1))["value"]).when(F.col("kind") == "customer", F.expr("aggregate(read, 0L, (a, r) -> a + r.value) div 100000")).otherwise(total)
    return F.struct(wants.alias("wants"), value.alias("value"))


@register("im_trace_verify", """
WITH o AS (SELECT o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS old, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 50 = 3 THEN 30000 ELSE 0 END AS new, o_orderkey % 50 = 3 AS ch FROM orders),
c AS (SELECT c_custkey AS c, c_nationkey AS n, coalesce(sum(old), 0) // 100000 AS old, coalesce(sum(new), 0) // 100000 AS new, coalesce(bool_or(ch), false) AS ran FROM customer LEFT JOIN o ON o.c = c_custkey GROUP BY ALL),
n AS (SELECT n_nationkey AS n, coalesce(sum(old), 0) AS old, coalesce(sum(new), 0) AS new, coalesce(bool_or(c.old <> c.new), false) AS ran FROM nation LEFT JOIN c ON c.n = n_nationkey GROUP BY ALL),
d AS (SELECT a.n, CASE WHEN a.new % 2 = 0 THEN b.new ELSE a.new END AS new, a.old <> a.new OR (a.old % 2 = 0 AND b.old <> b.new) AS ran FROM n a JOIN n b ON b.n = (a.n + 1) % 25)
SELECT 'customer' AS kind, c AS id, CAST(new AS BIGINT) AS value, ran FROM c WHERE n IN (SELECT n FROM n) UNION ALL SELECT 'nation', n, CAST(new AS BIGINT), ran FROM n UNION ALL SELECT 'cond', n, CAST(new AS BIGINT), ran FROM d""")
def im_trace_verify(spark, sf_dir):
    """Order totals are inputs; customers, nations and a choice for each nation are verified, then one order in 50 grows and all choices are
    asked for again: what was looked at the second time, and whether it ran. Ids are 4 times the key plus 0 to 3 for the kind."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    inputs = orders.select((F.col("o_orderkey") * 4).alias("node"), F.round(F.col("o_totalprice") * 100).cast("long").alias("old"), (F.col("o_orderkey") % 50 == 3).alias("changed"), "o_custkey")
    mine = inputs.groupBy("o_custkey").agg(F.sort_array(F.collect_list("node")).alias("args"))
    of = lambda key, kind: (F.col(key).cast("long") * 4 + kind).alias("node")
    empty = F.array().cast("array<long>")
    customers = customer.join(mine, F.col("c_custkey") == F.col("o_custkey"), "left").select(of("c_custkey", 1), F.lit("customer").alias("kind"), F.coalesce("args", empty).alias("args"), "c_nationkey")
    theirs = customers.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("node")).alias("args"))
    nations = nation.join(theirs, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(of("n_nationkey", 2), F.lit("nation").alias("kind"), F.coalesce("args", empty).alias("args"))
    next_one = ((F.col("n_nationkey").cast("long") + 1) % 25) * 4 + 2
    choices = nation.select(of("n_nationkey", 3), F.lit("cond").alias("kind"), F.array(F.col("n_nationkey").cast("long") * 4 + 2, next_one).alias("args"))
    traces = Traces(spark, f"{shared_root(spark)}/traces-{uuid.uuid4().hex}", _rollup_body)
    traces.register(customers.drop("c_nationkey").unionByName(nations).unionByName(choices))
    asked = choices.select("node")
    traces.verify(asked, inputs.select("node", F.col("old").alias("value"), F.lit(0).cast("long").alias("changed_at")), 1, 0)
    grown = inputs.select("node", (F.col("old") + F.when(F.col("changed"), 30000).otherwise(0)).alias("value"), F.when(F.col("changed"), 2).otherwise(0).cast("long").alias("changed_at"))
    found = traces.verify(asked, grown, 2, 1)
    kind = F.element_at(F.array(F.lit("customer"), F.lit("nation"), F.lit("cond")), (F.col("node") % 4).cast("int"))
    return found.select(kind.alias("kind"), F.expr("node div 4").alias("id"), "value", "ran")


@register("im_deep_chains", """
WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders),
s AS (SELECT k, r, r % 5003 = 77 AS missing, count(*) FILTER (r % 7001 = 1) OVER (ORDER BY r) AS chain FROM o),
b AS (SELECT k, missing, coalesce(bool_or(missing) OVER (PARTITION BY chain ORDER BY r), false) AS bad FROM s)
SELECT k AS node FROM b WHERE NOT bad""")
def im_deep_chains(spark, sf_dir):
    """Orders in chains of 7001, each resting on the one before; one in 5003 is missing, and all above it in its chain go."""
    orders = numbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node")), "r", F.col("node"), [])
    orders = cut(orders)
    nodes = orders.where("r % 5003 <> 77")
    below = orders.select(F.col("node").alias("dep"), (F.col("r") + 1).alias("r"))
    edges = nodes.where("r % 7001 <> 1").join(below, "r").select("node", "dep")
    return im.drop_dangling(edges, nodes)


@register("im_cycle_components", """
WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders)
SELECT min(k) AS component, count(*) AS n, string_agg(k, '>' ORDER BY r) || '>' || min(k) AS path FROM o WHERE c % 3 = 0 GROUP BY c, r // 6""")
def im_cycle_components(spark, sf_dir):
    """Each order of every third customer rests on the next one of its six, the last on the first; orders of others on their
    customer's first, and firsts on those of the next customer but for every sixth: the sixes are the cycles."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("node"))
    rows = orders.withColumn("six", F.expr("(row_number() OVER (PARTITION BY customer ORDER BY node) - 1) div 6"))
    six = Window.partitionBy("customer", "six")
    rows = cut(rows.withColumn("next", F.lead("node").over(six.orderBy("node"))).withColumn("first", F.min("node").over(six)))
    edges = rows.where("customer % 3 = 0").select("node", F.coalesce("next", "first").alias("dep"))
    firsts = rows.where("six = 0 AND node = first").select("customer", "first")
    edges = edges.unionByName(rows.where("customer % 3 <> 0").join(firsts.withColumnRenamed("first", "dep"), "customer").where("node <> dep").select("node", "dep"))
    following = firsts.select((F.col("customer") - 1).alias("customer"), F.col("first").alias("dep"))
    edges = cut(edges.unionByName(firsts.where("customer % 6 <> 5").join(following, "customer").select(F.col("first").alias("node"), "dep")))
    held = cut(im.components(edges))
    sizes = held.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return im.witnesses(edges, held).join(sizes, "component").select("component", "n", F.array_join("path", ">").alias("path"))


@register("im_cycle_paths", """
WITH RECURSIVE n AS (SELECT n_nationkey AS node FROM nation), e AS (SELECT node, (node * 3 + 1) % 25 AS dep FROM n UNION ALL SELECT node, (node + 7) % 25 FROM n WHERE node % 6 = 0),
p AS (SELECT node AS start, [node] AS path, false AS closed FROM n UNION ALL
  SELECT p.start, list_append(p.path, e.dep), list_contains(p.path, e.dep) FROM p JOIN e ON e.node = p.path[-1] WHERE NOT p.closed)
SELECT start, array_to_string(path, '>') AS path FROM p WHERE closed""")
def im_cycle_paths(spark, sf_dir):
    """Walks over nations, a graph of 25 nodes; the number of walks can grow with the power of a graph's branches."""
    nodes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    edges = nodes.select("node", ((F.col("node") * 3 + 1) % 25).alias("dep")).unionByName(nodes.where("node % 6 = 0").select("node", ((F.col("node") + 7) % 25).alias("dep")))
    return im.cycle_paths(edges, nodes, 25).select("start", F.array_join("path", ">").alias("path"))


@register("im_differential", """
WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 101 <> 7 GROUP BY ALL)
SELECT user_id, event_type, a.n AS model, b.n AS engine FROM a FULL OUTER JOIN b USING (user_id, event_type) WHERE a.n IS DISTINCT FROM b.n""")
def im_differential(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counted = lambda df: df.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return im.difference(counted(events), counted(events.where("event_id % 101 <> 7")), ["user_id", "event_type"], "n")


#: Levels of nodes above the inputs of the dataflow queries.
LEVELS = 4
#: Outcomes by level l and customer k, as `_dataflow_graph` builds the graph.
DATAFLOW = f"""
WITH RECURSIVE c AS (SELECT c_custkey AS k, CAST(floor(abs(c_acctbal)) AS BIGINT) % 12 AS x, (SELECT count(*) FROM customer) AS n FROM customer),
o AS (
  SELECT 0 AS l, k, CASE WHEN k % 97 <> 5 THEN x END AS v, CASE WHEN k % 97 = 5 THEN 'none' END AS e FROM c
  UNION ALL
  SELECT l, k, CASE WHEN err IS NULL THEN val END AS v, err AS e FROM (
    SELECT l, k,
      CASE t WHEN 1 THEN CASE WHEN v1 % 2 = 0 THEN v2 ELSE v3 END WHEN 2 THEN CASE ((v1 % 3) + 3) % 3 WHEN 0 THEN v2 WHEN 1 THEN v3 ELSE v4 END
             WHEN 3 THEN CASE WHEN v1 % 3 = 0 THEN v1 ELSE v1 + v2 + v3 + v4 END ELSE v1 + v2 + v3 END AS raw,
      CASE WHEN t = 3 AND v1 % 3 = 0 THEN raw ELSE ((raw % m) + m) % m END AS val,
      CASE t WHEN 1 THEN coalesce(e1, CASE WHEN v1 % 2 = 0 THEN e2 ELSE e3 END) WHEN 2 THEN coalesce(e1, CASE ((v1 % 3) + 3) % 3 WHEN 0 THEN e2 WHEN 1 THEN e3 ELSE e4 END)
             WHEN 3 THEN coalesce(e1, CASE WHEN v1 % 3 <> 0 THEN coalesce(e2, e3, e4) END)
             WHEN 4 THEN coalesce(e1, e2, e3, CASE WHEN raw % 3 = 0 THEN 'bad-' || ((raw % 2) + 2) % 2 END) ELSE coalesce(e1, e2, e3) END AS err
    FROM (
      SELECT l, k, t, m, CASE WHEN h THEN coalesce(v1, -length(e1)) ELSE v1 END AS v1, CASE WHEN h THEN coalesce(v2, -length(e2)) ELSE v2 END AS v2,
        CASE WHEN h THEN coalesce(v3, -length(e3)) ELSE v3 END AS v3, CASE WHEN h THEN coalesce(v4, -length(e4)) ELSE v4 END AS v4,
        CASE WHEN NOT h THEN e1 END AS e1, CASE WHEN NOT h THEN e2 END AS e2, CASE WHEN NOT h THEN e3 END AS e3, CASE WHEN NOT h THEN e4 END AS e4
      FROM (
        SELECT p.l + 1 AS l, c.k, (c.k + p.l + 1) % 5 AS t, 2 + (c.k + p.l + 1) % 4 AS m, (c.k + 2 * (p.l + 1)) % 4 = 0 AS h,
          p.v AS v1, p.e AS e1, q.v AS v2, q.e AS e2, r.v AS v3, r.e AS e3, s.v AS v4, s.e AS e4
        FROM c JOIN o p ON p.k = c.k JOIN o q ON q.k = (c.k * 3 + 1) % c.n JOIN o r ON r.k = (c.k * 7 + 2) % c.n JOIN o s ON s.k = (c.k + p.l + 1) % c.n WHERE p.l < {LEVELS}))))
"""


def _dataflow_graph(spark, sf_dir):
    """inputs and nodes: each customer's balance is an input, and on every level above each customer has a node, of a kind that its key and
    level give, over nodes of the level below. Ids are 8 times the key plus the level."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), "c_acctbal")
    n = customers.count()
    balance = F.when(F.col("k") % 97 != 5, F.floor(F.abs("c_acctbal")).cast("long") % 12)
    inputs = customers.select((F.col("k") * 8).alias("node"), balance.alias("value"))
    rows = customers.select("k", F.explode(F.expr(f"sequence(1L, {LEVELS}L)")).alias("l"))
    keys = F.array(F.col("k"), (F.col("k") * 3 + 1) % n, (F.col("k") * 7 + 2) % n, (F.col("k") + F.col("l")) % n)
    kind = F.element_at(F.array(*map(F.lit, dataflow.KINDS)), ((F.col("k") + F.col("l")) % 5 + 1).cast("int"))
    args = F.transform(F.slice(keys, 1, F.when(kind.isin("select", "guard"), 4).otherwise(3)), lambda a: a * 8 + F.col("l") - 1)
    return inputs, rows.select((F.col("k") * 8 + F.col("l")).alias("node"), kind.alias("kind"), args.alias("args"), (2 + (F.col("k") + F.col("l")) % 4).alias("m"), ((F.col("k") + 2 * F.col("l")) % 4 == 0).alias("handles"))


@register("im_dataflow_outcomes", DATAFLOW + "SELECT k AS customer, l AS level, CAST(v AS BIGINT) AS value, e AS error FROM o WHERE l > 0")
def im_dataflow_outcomes(spark, sf_dir):
    inputs, nodes = _dataflow_graph(spark, sf_dir)
    return dataflow.evaluate(nodes, inputs).select(F.expr("node div 8").alias("customer"), (F.col("node") % 8).cast("int").alias("level"), "value", "error")

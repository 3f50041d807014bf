"""Queries of scoring and validation, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import scoring as gr
from tessera.operators import validation as tl
from tessera.plans.registry import register
from tessera.sources.tables import table

WEIGHTS = [("1-URGENT", 0.3), ("2-HIGH", 0.25), ("3-MEDIUM", 0.2), ("4-NOT SPECIFIED", 0.15), ("5-LOW", 0.05), ("6-NEVER RUN", 0.05)]
CHECKS = """
WITH checks AS (SELECT o_orderpriority AS category, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS earned, 1 AS possible FROM orders),
categories AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {w}::DOUBLE)" for c, w in WEIGHTS) + """) t(category, weight)),
f AS (SELECT c.category, weight, count(k.category) AS checks, CASE WHEN count(k.category) > 0 THEN sum(earned) / sum(possible) ELSE 0 END AS fraction
  FROM categories c LEFT JOIN checks k USING (category) GROUP BY c.category, weight)
"""


def _fractions(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    checks = orders.select(F.col("o_orderpriority").alias("category"), (F.col("o_orderstatus") != "F").cast("int").alias("earned"), F.lit(1).alias("possible"))
    return gr.category_fractions(checks, spark.createDataFrame(WEIGHTS, "category string, weight double"))


@register("gr_category_fractions", CHECKS + "SELECT category, weight, checks, round(fraction, 9) AS fraction FROM f")
def gr_category_fractions(spark, sf_dir):
    return _fractions(spark, sf_dir).withColumn("fraction", F.round("fraction", 9))


@register("gr_weighted_score", CHECKS + "SELECT round(sum(weight * fraction), 9) AS score FROM f")
def gr_weighted_score(spark, sf_dir):
    return gr.weighted(_fractions(spark, sf_dir)).select(F.round("score", 9).alias("score"))


@register("gr_multiplier_score", CHECKS + """
, m AS (SELECT coalesce(max(fraction) FILTER (category = '5-LOW'), 0) AS multiplier FROM f)
SELECT round(sum(weight * fraction) FILTER (category <> '5-LOW') / sum(weight) FILTER (category <> '5-LOW') * any_value(multiplier), 9) AS score, round(any_value(multiplier), 9) AS multiplier, bool_and(fraction >= 1) AS all_green FROM f, m""")
def gr_multiplier_score(spark, sf_dir):
    rows = gr.weighted_with_multiplier(_fractions(spark, sf_dir), "5-LOW")
    return rows.select(F.round("score", 9).alias("score"), F.round("multiplier", 9).alias("multiplier"), "all_green")


@register("gr_lenient_score", CHECKS + "SELECT round(sum(weight * fraction), 9) AS score FROM f")
def gr_lenient_score(spark, sf_dir):
    """The multiplier category has no checks here, which counts as 1."""
    return gr.weighted_lenient(_fractions(spark, sf_dir), "6-NEVER RUN").select(F.round("score", 9).alias("score"))


@register("gr_partial_credit", "SELECT o_orderkey, greatest(0, least(1, (400000 - o_totalprice) / 300000::DOUBLE)) AS credit FROM orders")
def gr_partial_credit(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", gr.partial_credit(F.col("o_totalprice"), F.lit(100000.0), F.lit(400000.0)).alias("credit"))


@register("gr_worst_case", "SELECT max(o_totalprice) AS worst, min(o_orderkey) FILTER (o_totalprice = m) AS at FROM orders, (SELECT max(o_totalprice) AS m FROM orders)")
def gr_worst_case(spark, sf_dir):
    return gr.worst(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


EVENT_SLICES = [f"SELECT user_id % 10 AS u, event_type AS e FROM events WHERE event_id % 4 {op}" for op in ("< 2", ">= 1")]


@register("gr_multiset_diff", f"SELECT u, e, 'left' AS side FROM ({EVENT_SLICES[0]} EXCEPT ALL {EVENT_SLICES[1]}) UNION ALL SELECT u, e, 'right' FROM ({EVENT_SLICES[1]} EXCEPT ALL {EVENT_SLICES[0]})")
def gr_multiset_diff(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    part = lambda cond: events.where(cond).select((F.col("user_id") % 10).alias("u"), F.col("event_type").alias("e"))
    return gr.multiset_difference(part("event_id % 4 < 2"), part("event_id % 4 >= 1"))


@register("gr_set_operations", """
SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL
SELECT 'difference', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def gr_set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "difference": a.subtract(b)}
    out = [df.select(F.lit(op).alias("op"), "k") for op, df in named.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register("gr_expansion_bound", "SELECT doc_id, strlen(text) + 64 + strlen(text) // 64 AS bound FROM documents")
def gr_expansion_bound(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gr.expansion_bound(F.octet_length("text").cast("long")).alias("bound"))


@register("gr_joined_vs_separate", """
WITH s AS (SELECT source, sum(strlen(text)) AS bytes, count(*) AS n FROM documents GROUP BY source), p AS (SELECT a.source AS a, b.source AS b, a.bytes + b.bytes AS joined, a.bytes AS x, b.bytes AS y, a.n + b.n AS n FROM s a JOIN s b ON a.source < b.source)
SELECT a, b, CAST(joined + 24 * n AS BIGINT) AS joined, joined + 24 * n <= 1.05 * (x + y) AS ok, CAST(abs(x - y) AS BIGINT) AS drift FROM p""")
def gr_joined_vs_separate(spark, sf_dir):
    """Sizes of pairs of sources, framed with 24 bytes a document, against 1.05 times the sum, and their drift."""
    s = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n"))
    p = s.alias("a").join(F.broadcast(s.alias("b")), F.col("a.source") < F.col("b.source"))
    joined = F.col("a.bytes") + F.col("b.bytes") + 24 * (F.col("a.n") + F.col("b.n"))
    return p.select(F.col("a.source").alias("a"), F.col("b.source").alias("b"), joined.alias("joined"), (joined <= 1.05 * (F.col("a.bytes") + F.col("b.bytes"))).alias("ok"), F.abs(F.col("a.bytes") - F.col("b.bytes")).alias("drift"))


@register("gr_small_frames", "SELECT count(*) AS frames, CAST(sum(strlen(text)) AS BIGINT) AS payload, CAST(sum(strlen(text) + 20) AS BIGINT) AS framed, sum(strlen(text) + 20) <= sum(strlen(text)) + 24 * count(*) AS ok FROM documents WHERE strlen(text) <= 256")
def gr_small_frames(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    rows = table(spark, sf_dir, "documents").where(size <= 256).agg(F.count(F.lit(1)).alias("frames"), F.sum(size).alias("payload"), F.sum(size + 20).alias("framed"))
    return rows.withColumn("ok", F.col("framed") <= F.col("payload") + 24 * F.col("frames"))


LANGS = ("en", "fr", "de")


def _doc_rules():
    return {
        **tl.length_rules("text", 200, 5000),
        "lang_unknown": ("error", ~F.col("lang").isin(*LANGS)),
        "chars_differ": ("warning", F.col("n_chars") != F.length("text")),
        "source_name": ("warning", ~F.col("source").rlike(tl.KEBAB)),
    }


RULES = """
WITH d AS (SELECT doc_id, length(rtrim(text, chr(10))) AS size, lang, n_chars, length(text) AS chars, source FROM documents),
v AS (
  SELECT doc_id, 'text_short' AS rule, 'error' AS severity FROM d WHERE size < 200 UNION ALL SELECT doc_id, 'text_long', 'error' FROM d WHERE size > 5000
  UNION ALL SELECT doc_id, 'text_near', 'warning' FROM d WHERE size BETWEEN 4500 AND 5000 UNION ALL SELECT doc_id, 'lang_unknown', 'error' FROM d WHERE lang NOT IN ('en', 'fr', 'de')
  UNION ALL SELECT doc_id, 'chars_differ', 'warning' FROM d WHERE n_chars <> chars UNION ALL SELECT doc_id, 'source_name', 'warning' FROM d WHERE NOT regexp_matches(source, '^[a-z0-9]+(-[a-z0-9]+)*$'))
"""


@register("tl_bounds_violations", RULES + "SELECT * FROM v")
def tl_bounds_violations(spark, sf_dir):
    return tl.violations(table(spark, sf_dir, "documents"), "doc_id", _doc_rules())


@register("tl_rule_rollup", RULES + """
SELECT d.doc_id, CAST(count(*) FILTER (severity = 'error') AS INTEGER) AS errors, CAST(count(*) FILTER (severity = 'warning') AS INTEGER) AS warnings,
  CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'FAIL' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'WARN' ELSE 'OK' END AS status
FROM d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id""")
def tl_rule_rollup(spark, sf_dir):
    return tl.rollup(table(spark, sf_dir, "documents"), "doc_id", _doc_rules())


@register("tl_enum_violations", "SELECT doc_id, quality, toxic FROM labels WHERE quality NOT IN (1) OR toxic NOT IN (0)")
def tl_enum_violations(spark, sf_dir):
    return table(spark, sf_dir, "labels").where(~F.col("quality").isin(1) | ~F.col("toxic").isin(0)).select("doc_id", "quality", "toxic")


@register("tl_first_failing_reason", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'not ok' WHEN o_totalprice > 400000 THEN 'over budget' WHEN o_orderpriority LIKE '5%' THEN 'low priority' END AS reason FROM orders""")
def tl_first_failing_reason(spark, sf_dir):
    reason = tl.first_reason([("not ok", F.col("o_orderstatus") == "F"), ("over budget", F.col("o_totalprice") > 400000), ("low priority", F.col("o_orderpriority").startswith("5"))])
    return table(spark, sf_dir, "orders").select("o_orderkey", reason.alias("reason"))


@register("tl_required_missing", "SELECT n_nationkey, o_orderpriority FROM nation, (SELECT DISTINCT o_orderpriority FROM orders) WHERE (n_nationkey, o_orderpriority) NOT IN (SELECT c_nationkey, o_orderpriority FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey % 40 = 0)")
def tl_required_missing(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    required = table(spark, sf_dir, "nation").select("n_nationkey").crossJoin(F.broadcast(orders.select("o_orderpriority").distinct()))
    present = orders.where("o_orderkey % 40 = 0").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority")
    return tl.missing_required(required, present, ["n_nationkey", "o_orderpriority"])


@register("tl_case_duplicates", """
SELECT lower(w) AS lowered, count(DISTINCT w) AS spellings FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY 1 HAVING count(DISTINCT w) > 1""")
def tl_case_duplicates(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    return tl.case_duplicates(words, "w")


@register("tl_content_hash_dups", """
SELECT substr(sha256(text), 1, 16) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def tl_content_hash_dups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(tl.content_hash(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("tl_crossdoc_rules", """
WITH l AS (SELECT l_orderkey, count(*) AS lines, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, max(l_shipdate) AS last FROM lineitem GROUP BY 1)
SELECT o_orderkey, lines > 4 AS too_many, cents > CAST(round(o_totalprice * 100) AS BIGINT) AS over_total, last < o_orderdate AS too_early, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS state
FROM orders JOIN l ON l_orderkey = o_orderkey""")
def tl_crossdoc_rules(spark, sf_dir):
    """A part may ask for less than the whole, never more."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"), F.max("l_shipdate").alias("last"))
    state = F.create_map(*(F.lit(x) for x in ("F", "final", "O", "open", "P", "partial")))[F.col("o_orderstatus")]
    rows = table(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("o_orderkey", (F.col("lines") > 4).alias("too_many"), (F.col("cents") > F.round(F.col("o_totalprice") * 100).cast("long")).alias("over_total"), (F.col("last") < F.col("o_orderdate")).alias("too_early"), state.alias("state"))


PATHS = "SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages"


@register("tl_path_predicates", f"SELECT page_id, path LIKE '/%' OR list_contains(string_split(path, '/'), '..') AS unsafe, regexp_matches(string_split(path, '/')[2], '^[a-z0-9]+(-[a-z0-9]+)*$') AS slug FROM ({PATHS})")
def tl_path_predicates(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", tl.unsafe_path(path).alias("unsafe"), F.get(F.split(path, "/"), F.lit(1)).rlike(tl.KEBAB).alias("slug"))


#: Paths of an archive made of `pages`: host, language and page, some with junk names, a folder for each host.
ARCHIVE = """
(SELECT page_id, 'wrap/' || split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '.', 1) || '/' ||
   CASE page_id % 5 WHEN 0 THEN 'a.toml' WHEN 1 THEN 'b.md' WHEN 2 THEN '.DS_Store' WHEN 3 THEN 'tests/' ELSE 'src/a.toml' END AS path FROM pages) p
"""


def _archive(spark, sf_dir) -> DataFrame:
    host = "split_part(split_part(regexp_replace(url, '^https?://', ''), '/', 1), '.', 1)"
    name = "element_at(array('a.toml', 'b.md', '.DS_Store', 'tests/', 'src/a.toml'), CAST(1 + page_id % 5 AS INT))"
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"concat('wrap/', {host}, '/', {name}) AS path")


@register("tl_shortest_cover", f"""
WITH levels AS (SELECT path, unnest(range(0, len(string_split(path, '/')))) AS depth FROM {ARCHIVE}),
cut AS (SELECT depth, array_to_string(string_split(path, '/')[1:depth], '/') AS prefix, array_to_string(string_split(path, '/')[depth + 1:], '/') AS rest FROM levels),
full_ AS (SELECT depth, prefix FROM cut WHERE rest IN ('a.toml', 'b.md') GROUP BY depth, prefix HAVING count(DISTINCT rest) = 2)
SELECT (SELECT prefix FROM full_ ORDER BY depth, length(prefix), prefix LIMIT 1) AS prefix""")
def tl_shortest_cover(spark, sf_dir):
    return tl.shortest_cover(_archive(spark, sf_dir), "path", ["a.toml", "b.md"])


@register("tl_repaired_paths", f"SELECT page_id, path, CASE WHEN path LIKE 'wrap/m/%' THEN substr(path, 8) ELSE path END AS repaired FROM {ARCHIVE} WHERE path NOT LIKE '%/' AND path NOT LIKE '%.DS_Store'")
def tl_repaired_paths(spark, sf_dir):
    return tl.repaired(_archive(spark, sf_dir), "path", "wrap/m", [".DS_Store"])


@register("tl_conditional_mode", "SELECT p_partkey, (p_size % 3 = 0 AND p_type = 'ECONOMY') OR (p_size % 3 <> 0 AND p_type = 'SMALL') AS broken FROM part")
def tl_conditional_mode(spark, sf_dir):
    """An allow-list (sizes divisible by 3) must not be of one type, no list must not be of another."""
    listed = F.col("p_size") % 3 == 0
    return table(spark, sf_dir, "part").select("p_partkey", ((listed & (F.col("p_type") == "ECONOMY")) | (~listed & (F.col("p_type") == "SMALL"))).alias("broken"))


@register("tl_total_size", "SELECT count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS bytes, sum(strlen(html)) <= 512 * 1024 * 1024 AS within FROM pages")
def tl_total_size(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("html").cast("long")).alias("bytes"))
    return rows.withColumn("within", F.col("bytes") <= 512 * 1024 * 1024)


@register("tl_render_record", "SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || '- region: ' || r_name || chr(10) || '- key: ' || n_nationkey AS rendered FROM nation JOIN region ON r_regionkey = n_regionkey")
def tl_render_record(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("n_nationkey", F.format_string("# %s\n\n- region: %s\n- key: %d", "n_name", "r_name", "n_nationkey").alias("rendered"))


@register("tl_stale_records", """
WITH now AS (SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || '- region: ' || r_name || chr(10) || '- key: ' || n_nationkey AS t FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 3 THEN 'missing' ELSE 'stale' END AS state FROM now WHERE n_nationkey % 7 = 3 OR n_nationkey % 5 = 1""")
def tl_stale_records(spark, sf_dir):
    """Rendered records against a stored copy that lacks some and has others with another line."""
    now = tl_render_record(spark, sf_dir)
    stored = now.where("n_nationkey % 7 <> 3").withColumn("rendered", F.when(F.col("n_nationkey") % 5 == 1, F.concat("rendered", F.lit("\n- old"))).otherwise(F.col("rendered")))
    return tl.stale(now, stored, "n_nationkey", "rendered")


PATHS = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'a/__pycache__/x' WHEN 1 THEN 'verifier/x.py' WHEN 2 THEN 'a/verifier' WHEN 3 THEN 'b/score.json' WHEN 4 THEN 'b/x.pyc' WHEN 5 THEN 'b/.pyc' WHEN 6 THEN 'scores.json' WHEN 7 THEN '.git' ELSE 'c/d' || p_size || '.py' END AS path FROM part"


@register("tl_artefacts", f"SELECT p_partkey, path FROM ({PATHS}) WHERE p_partkey % 9 IN (0, 1, 3, 4, 7)")
def tl_artefacts(spark, sf_dir):
    """Paths made of `part` that are left behind by a run."""
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(PATHS.replace("p_size ||", "CAST(p_size AS STRING) ||"))
    return rows.where(tl.artefact(F.col("path"), ["__pycache__", ".git"], ["verifier"], ["score.json"], [".pyc"]))


@register("tl_key_rules", """
WITH r AS (SELECT p_partkey, list_filter(['name', 'size', 'secret'], lambda k : CASE k WHEN 'name' THEN p_partkey % 7 <> 0 WHEN 'size' THEN p_size > 5 ELSE p_partkey % 11 = 0 END) AS keys, (p_partkey % 13 - 1) / 10.0 AS pass FROM part)
SELECT p_partkey, 'name_required' AS rule FROM r WHERE NOT list_contains(keys, 'name') UNION ALL SELECT p_partkey, 'size_required' FROM r WHERE NOT list_contains(keys, 'size')
UNION ALL SELECT p_partkey, 'secret_forbidden' FROM r WHERE list_contains(keys, 'secret') UNION ALL SELECT p_partkey, 'pass_threshold' FROM r WHERE pass <= 0 OR pass > 1""")
def tl_key_rules(spark, sf_dir):
    """Keys and a threshold made of `part`: which rules each row breaks."""
    part = table(spark, sf_dir, "part")
    keys = F.array_compact(F.array(F.when(F.col("p_partkey") % 7 != 0, "name"), F.when(F.col("p_size") > 5, "size"), F.when(F.col("p_partkey") % 11 == 0, "secret")))
    rows = part.select("p_partkey", keys.alias("keys"), ((F.col("p_partkey") % 13 - 1) / 10).alias("pass"))
    rules = tl.key_rules("keys", ["name", "size"], ["secret"]) | tl.threshold_rule("pass")
    broken = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, (_, condition) in rules.items())))
    return rows.select("p_partkey", F.explode(broken).alias("rule"))


@register("tl_identifiers", """
WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--.*?-->|/\\*.*?\\*/|"[^"\\n]*"|''[^''\\n]*''|[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_<"''/]+|.')) AS word, generate_subscripts(regexp_extract_all(html, '(?s)<!--.*?-->|/\\*.*?\\*/|"[^"\\n]*"|''[^''\\n]*''|[A-Za-z_][A-Za-z0-9_]*|[^A-Za-z_<"''/]+|.'), 1) AS nth FROM pages),
s AS (SELECT page_id, word, 1 + coalesce(sum(length(word)) OVER (PARTITION BY page_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p)
SELECT page_id, word, CAST(min(start) AS BIGINT) AS start, count(*) AS n FROM s WHERE regexp_matches(word, '^[A-Za-z_][A-Za-z0-9_]*$') AND word NOT IN ('p', 'a', 'li', 'ul', 'div', 'br', 'b', 'href', 'class') GROUP BY page_id, word""")
def tl_identifiers(spark, sf_dir):
    """The words of each page's source outside of comments and strings, but for some tags: first place and count."""
    allowed = spark.createDataFrame([(w,) for w in ("p", "a", "li", "ul", "div", "br", "b", "href", "class")], "word string")
    found = tl.identifiers(table(spark, sf_dir, "pages"), "page_id", "html", allowed)
    return found.groupBy("page_id", "word").agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("n"))

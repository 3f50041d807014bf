"""Queries over version constraints; packages are the brands of `part`, versions are made of its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import versions as v
from tessera.operators import constraints as pk
from tessera.operators import solver
from tessera.operators.lineage import cut
from tessera.plans.registry import register
from tessera.sources.tables import table

RELEASES = """
WITH releases AS (SELECT DISTINCT p_brand AS package, p_size AS a, p_partkey % 10 AS b, p_partkey % 7 AS c FROM part),
tests AS (SELECT * FROM (VALUES ('t1', 10, 0, 0, 40, 0, 0), ('t2', 0, 0, 0, 25, 5, 0), ('t3', 30, 2, 1, 99, 0, 0)) t(test, la, lb, lc, ha, hb, hc))
"""
INSIDE = "(a, b, c) >= (la, lb, lc) AND (a, b, c) < (ha, hb, hc) AND NOT (a = 20 AND b = 0 AND c = 0)"
TEXT = "a || '.' || b || '.' || c"
TESTS = [("t1", ">=10.0.0,<40.0.0,!=20.0.0"), ("t2", ">=0.0.0, <25.5.0, !=20.0.0"), ("t3", ">=30.2.1,<99.0.0,!=20.0.0")]


def part_releases(spark, sf_dir) -> DataFrame:
    """package, version."""
    part = table(spark, sf_dir, "part")
    made = F.struct(F.col("p_size").cast("long").alias("major"), (F.col("p_partkey") % 10).alias("minor"), (F.col("p_partkey") % 7).alias("patch"))
    return part.select(F.col("p_brand").alias("package"), made.alias("version")).distinct()


def asked(spark, releases: DataFrame) -> DataFrame:
    """test, target, range: every test asked of every package; three rows, so broadcast."""
    tests = spark.createDataFrame(TESTS, "test string, spec string").select("test", v.version_range(F.col("spec")).alias("range"))
    return releases.select(F.col("package").alias("target")).distinct().crossJoin(F.broadcast(tests))


@register("pk_version_order", RELEASES + f"SELECT package, {TEXT} AS version, row_number() OVER (PARTITION BY package ORDER BY a DESC, b DESC, c DESC) AS rank FROM releases")
def pk_version_order(spark, sf_dir):
    return pk.newest_first(part_releases(spark, sf_dir)).select("package", v.version_text(F.col("version")).alias("version"), "rank")


SPECS = """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size || '.' || p_partkey || '.0' WHEN 1 THEN '0' || p_size || '.1.2' WHEN 2 THEN p_size || '.1'
  WHEN 3 THEN p_size || '.0.' || p_partkey % 3 || ' ' WHEN 4 THEN '0.0.' || p_size ELSE 'v1.2.' || p_size END AS spec FROM part
"""


@register("pk_version_parse", f"""
SELECT p_partkey, regexp_matches(spec, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$') AS valid,
  CASE WHEN regexp_matches(spec, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$') THEN CAST(split_part(spec, '.', 1) AS BIGINT) END AS major,
  CASE WHEN regexp_matches(spec, '^(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)\\.(0|[1-9][0-9]*)$') THEN CAST(split_part(spec, '.', 3) AS BIGINT) END AS patch FROM ({SPECS})""")
def pk_version_parse(spark, sf_dir):
    spec = F.expr("CASE p_partkey % 6 WHEN 0 THEN concat(p_size, '.', p_partkey, '.0') WHEN 1 THEN concat('0', p_size, '.1.2') WHEN 2 THEN concat(p_size, '.1') "
                  "WHEN 3 THEN concat(p_size, '.0.', p_partkey % 3, ' ') WHEN 4 THEN concat('0.0.', p_size) ELSE concat('v1.2.', p_size) END")  # fmt: skip
    rows = table(spark, sf_dir, "part").select("p_partkey", v.version(spec).alias("v"))
    return rows.select("p_partkey", F.col("v").isNotNull().alias("valid"), "v.major", "v.patch")


@register("pk_range_canonical", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '*' WHEN 1 THEN '>=' || p_size || '.0.0,<' || (p_size + 2) || '.0.0' WHEN 2 THEN '>=' || p_size || '.0.0,<' || (p_size + 2) || '.0.0'
  WHEN 3 THEN '>' || p_size || '.2.0,!=' || p_size || '.2.3' END AS canonical, CASE WHEN p_partkey % 6 < 4 THEN p_partkey % 6 = 0 END AS is_any FROM part""")
def pk_range_canonical(spark, sf_dir):
    """Ranges written in another order, with blanks and twice over have one canonical text; two kinds are no ranges."""
    spec = F.expr("CASE p_partkey % 6 WHEN 0 THEN IF(p_size % 2 = 0, '*', ' ') WHEN 1 THEN concat('<', p_size + 2, '.0.0, >=', p_size, '.0.0') WHEN 2 THEN concat('>=', p_size, '.0.0,<', p_size + 2, '.0.0,>=', p_size, '.0.0') "
                  "WHEN 3 THEN concat('!=', p_size, '.2.3,> ', p_size, '.2.0') WHEN 4 THEN concat('~', p_size, '.0.0') ELSE concat('>=', p_size, '.0') END")  # fmt: skip
    rows = table(spark, sf_dir, "part").select("p_partkey", v.version_range(spec).alias("r"))
    return rows.select("p_partkey", F.when(F.col("r").isNotNull(), v.range_text(F.col("r"))).alias("canonical"), F.when(F.col("r").isNotNull(), F.size("r") == 0).alias("is_any"))


@register("pk_requirement_parse", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'lib' || p_size WHEN 1 THEN 'my-lib' || p_size WHEN 4 THEN 'a' END AS package,
  CASE p_partkey % 5 WHEN 0 THEN '*' WHEN 1 THEN '>=' || p_size || '.0.0' WHEN 4 THEN '!=' || p_size || '.0.0,<=' || (p_size + 1) || '.0.0' END AS canonical FROM part""")
def pk_requirement_parse(spark, sf_dir):
    spec = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('lib', p_size) WHEN 1 THEN concat(' my-lib', p_size, '  >=', p_size, '.0.0 ') WHEN 2 THEN concat('My-lib', p_size, ' *') "
                  "WHEN 3 THEN concat('lib >=x', p_size) ELSE concat('a <=', p_size + 1, '.0.0,!=', p_size, '.0.0') END")  # fmt: skip
    rows = table(spark, sf_dir, "part").select("p_partkey", v.requirement(spec).alias("q"))
    return rows.select("p_partkey", "q.package", F.when(F.col("q").isNotNull(), v.range_text(F.col("q.range"))).alias("canonical"))


@register("pk_range_match", RELEASES + f"SELECT test, package AS target, {TEXT} AS version FROM releases, tests WHERE {INSIDE}")
def pk_range_match(spark, sf_dir):
    releases = part_releases(spark, sf_dir)
    return pk.matches(asked(spark, releases), releases).select("test", "target", v.version_text(F.col("found")).alias("version"))


@register("pk_range_join", """
WITH releases AS (SELECT DISTINCT l_suppkey AS package, year(l_shipdate) AS a, month(l_shipdate) AS b, day(l_shipdate) AS c FROM lineitem),
asks AS (SELECT p_partkey AS asker, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 1 + p_partkey % 97 END AS target, 1992 + p_size % 6 AS y, 1 + p_partkey % 12 AS m FROM part)
SELECT asker, target, a || '.' || b || '.' || c AS found FROM asks JOIN releases ON package = target
WHERE (a, b, c) >= (y, m, 0) AND (a, b, c) < (y + 1, m, 0) AND NOT (a = y AND b = m AND c IN (3, 4))""")
def pk_range_join(spark, sf_dir):
    """Every part asks a supplier for the days of a year but two; half of the parts ask the same one."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    day = F.struct(*(f("l_shipdate").cast("long").alias(n) for f, n in ((F.year, "major"), (F.month, "minor"), (F.dayofmonth, "patch"))))
    releases = lines.select(F.col("l_suppkey").cast("string").alias("package"), day.alias("version")).distinct()
    spec = F.expr("concat('>=', 1992 + p_size % 6, '.', 1 + p_partkey % 12, '.0,<', 1993 + p_size % 6, '.', 1 + p_partkey % 12, '.0,!=', 1992 + p_size % 6, '.', 1 + p_partkey % 12, '.3,!=', 1992 + p_size % 6, '.', 1 + p_partkey % 12, '.4')")
    # a text that many parts ask with is parsed once
    asks = part.select(F.col("p_partkey").alias("asker"), F.expr("IF(p_partkey % 2 = 0, 1, 1 + p_partkey % 97)").cast("string").alias("target"), spec.alias("spec"))
    parsed = cut(asks.select("spec").distinct().withColumn("range", v.version_range(F.col("spec"))))
    asks = asks.join(parsed, "spec").drop("spec")
    return pk.matches(asks, releases).select("asker", F.col("target").cast("long").alias("target"), v.version_text(F.col("found")).alias("found"))


@register("pk_newest_match", RELEASES + f"""
SELECT test, package AS target, first({TEXT} ORDER BY a DESC, b DESC, c DESC) FILTER ({INSIDE}) AS newest FROM releases, tests GROUP BY test, package""")
def pk_newest_match(spark, sf_dir):
    releases = part_releases(spark, sf_dir)
    rows = pk.newest_match(asked(spark, releases), releases, ["test", "target"])
    return rows.select("test", "target", F.when(F.col("newest").isNotNull(), v.version_text(F.col("newest"))).alias("newest"))


@register("pk_signature_classes", RELEASES + f"""
, s AS (SELECT package, a, b, c, coalesce(string_agg(test, ',' ORDER BY test) FILTER ({INSIDE}), '') AS signature FROM releases, tests GROUP BY ALL)
SELECT package, signature, first({TEXT} ORDER BY a DESC, b DESC, c DESC) AS newest, count(*) AS n FROM s GROUP BY package, signature""")
def pk_signature_classes(spark, sf_dir):
    releases = part_releases(spark, sf_dir)
    rows = pk.signature_classes(releases, asked(spark, releases))
    return rows.select("package", F.array_join("signature", ",").alias("signature"), v.version_text(F.col("newest")).alias("newest"), "n")


@register("pk_contiguous_runs", RELEASES + f"""
, o AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY a, b, c) AS ord FROM releases),
r AS (SELECT *, ord - row_number() OVER (PARTITION BY package ORDER BY a, b, c) AS run FROM o WHERE b < 7)
SELECT package, first({TEXT} ORDER BY a, b, c) AS first, last({TEXT} ORDER BY a, b, c) AS last, count(*) AS n FROM r GROUP BY package, run""")
def pk_contiguous_runs(spark, sf_dir):
    rows = pk.contiguous_runs(part_releases(spark, sf_dir).withColumn("ok", F.col("version.minor") < 7), "ok")
    return rows.select("package", v.version_text(F.col("first")).alias("first"), v.version_text(F.col("last")).alias("last"), "n")


@register("pk_learned_window", RELEASES + """
, asks AS (SELECT package, a, b, c, 'Brand#' || (1 + (a + b) % 2) AS target, a - 5 AS low, a + 5 AS high FROM releases WHERE NOT (package = 'Brand#3' AND c = 0) AND package <> 'Brand#1'),
one AS (SELECT package, any_value(target) AS target FROM (SELECT package, a, b, c, 'Brand#1' AS target FROM releases WHERE package NOT IN ('Brand#1', 'Brand#3')) GROUP BY package)
SELECT DISTINCT o.package, o.target, t.a || '.' || t.b || '.' || t.c AS allowed FROM one o JOIN releases r ON r.package = o.package JOIN releases t ON t.package = o.target AND t.a >= r.a - 5 AND t.a < r.a + 5""")
def pk_learned_window(spark, sf_dir):
    # every release asks for Brand#1 near its own major number, but one release of Brand#3 in seven does not
    releases = part_releases(spark, sf_dir)
    bound = lambda op, d: F.struct(F.struct(F.greatest(F.lit(0), F.col("version.major") + d).cast("long").alias("major"), F.lit(0).cast("long").alias("minor"), F.lit(0).cast("long").alias("patch")).alias("version"), F.lit(op).alias("op"))
    asks = releases.where("package <> 'Brand#1' AND NOT (package = 'Brand#3' AND version.patch = 0)").withColumn("target", F.lit("Brand#1")).withColumn("range", F.array(bound(">=", -5), bound("<", 5)))
    rows = pk.learned_window(releases, asks)
    return rows.select("package", "target", F.explode("allowed").alias("a")).select("package", "target", v.version_text(F.col("a")).alias("allowed"))


#: A universe for each brand u. Its packages a, b and c have as major versions the sizes, by 4, of its parts. Every a x asks for
#: b >= (x + u) % 4 and, if x is odd, for c <= x; a b x from 2 on asks for c >= 1 but not (x + u) % 4; c 3 asks for a >= 2.
#: The roots ask for a, of universes divisible by 5 for a 3, and, if u is even, for b < 3.
UNIVERSES = """
WITH RECURSIVE rel AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS u, ['a', 'b', 'c'][1 + p_partkey % 3] AS package, p_size % 4 AS x FROM part),
req AS (
  SELECT u, package, x, 'b' AS target, '>=' || ((x + u) % 4) || '.0.0' AS spec FROM rel WHERE package = 'a'
  UNION ALL SELECT u, package, x, 'c', '<=' || x || '.0.0' FROM rel WHERE package = 'a' AND x % 2 = 1
  UNION ALL SELECT u, package, x, 'c', '>=1.0.0' FROM rel WHERE package = 'b' AND x >= 2
  UNION ALL SELECT u, package, x, 'c', '!=' || ((x + u) % 4) || '.0.0' FROM rel WHERE package = 'b' AND x >= 2
  UNION ALL SELECT u, package, x, 'a', '>=2.0.0' FROM rel WHERE package = 'c' AND x = 3),
roots AS (SELECT DISTINCT u, 'a' AS target FROM rel UNION ALL SELECT DISTINCT u, 'b' FROM rel WHERE u % 2 = 0)
"""
SOLUTIONS = UNIVERSES + """
, a AS (SELECT u, x FROM rel WHERE package = 'a'), b AS (SELECT u, x FROM rel WHERE package = 'b'), c AS (SELECT u, x FROM rel WHERE package = 'c' UNION ALL SELECT DISTINCT u, NULL FROM rel),
valid AS (
  SELECT a.u, a.x AS xa, b.x AS xb, c.x AS xc FROM a JOIN b USING (u) JOIN c USING (u)
  WHERE (a.u % 5 <> 0 OR a.x = 3) AND b.x >= (a.x + a.u) % 4 AND (a.u % 2 <> 0 OR b.x < 3) AND (c.x IS NOT NULL) = (a.x % 2 = 1 OR b.x >= 2)
    AND (c.x IS NULL OR ((a.x % 2 = 0 OR c.x <= a.x) AND (b.x < 2 OR (c.x >= 1 AND c.x <> (b.x + a.u) % 4)) AND (c.x < 3 OR a.x >= 2)))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY xa DESC, xb DESC, xc DESC) AS r FROM valid) WHERE r = 1)
"""
CHOSEN = "SELECT u AS universe, 'a' AS package, xa || '.0.0' AS version FROM best UNION ALL SELECT u, 'b', xb || '.0.0' FROM best UNION ALL SELECT u, 'c', xc || '.0.0' FROM best WHERE xc IS NOT NULL"


def universes(spark, sf_dir):
    """releases, requirements and roots of the universes made of `part`, see UNIVERSES."""
    made = table(spark, sf_dir, "part").selectExpr("CAST(substr(p_brand, 7) AS INT) AS universe", "element_at(array('a', 'b', 'c'), CAST(1 + p_partkey % 3 AS INT)) AS package", "p_size % 4 AS x").distinct()
    asks = F.expr("""
      CASE WHEN package = 'a' THEN concat(array(struct('b' AS target, concat('>=', (x + universe) % 4, '.0.0') AS spec)), IF(x % 2 = 1, array(struct('c' AS target, concat('<=', x, '.0.0') AS spec)), array()))
           WHEN package = 'b' AND x >= 2 THEN array(struct('c' AS target, '>=1.0.0' AS spec), struct('c' AS target, concat('!=', (x + universe) % 4, '.0.0') AS spec))
           WHEN package = 'c' AND x = 3 THEN array(struct('a' AS target, '>=2.0.0' AS spec)) ELSE array() END""")
    made = made.withColumn("version", F.struct(F.col("x").cast("long").alias("major"), F.lit(0).cast("long").alias("minor"), F.lit(0).cast("long").alias("patch")))
    requirements = made.select("universe", "package", "version", F.posexplode(asks)).select("universe", "package", "version", "col.target", v.version_range(F.col("col.spec")).alias("range"), "pos")
    named = made.select("universe").distinct()
    roots = named.select("universe", F.lit("a").alias("target"), v.version_range(F.expr("IF(universe % 5 = 0, '==3.0.0', '*')")).alias("range"))
    roots = roots.unionByName(named.where("universe % 2 = 0").select("universe", F.lit("b").alias("target"), v.version_range(F.lit("<3.0.0")).alias("range")))
    return made.select("universe", "package", "version"), requirements, roots


@register("pk_closure", UNIVERSES + """
, c AS (SELECT u, target AS package FROM roots UNION SELECT c.u, req.target FROM c JOIN req ON req.u = c.u AND req.package = c.package)
SELECT u AS universe, package FROM c""")
def pk_closure(spark, sf_dir):
    _, requirements, roots = universes(spark, sf_dir)
    name = lambda c: F.concat_ws(":", F.col("universe").cast("string"), F.col(c))
    nodes = pk.closure(requirements.select(name("package").alias("src"), name("target").alias("dst")).distinct(), roots.select(name("target").alias("node")))
    parts = F.split("node", ":")
    return nodes.select(parts[0].cast("int").alias("universe"), parts[1].alias("package"))


@register("pk_fact_problems", UNIVERSES + """
, told AS (SELECT p_partkey AS fact, CAST(substr(p_brand, 7) AS INTEGER) AS u, ['a', 'b', 'c'][1 + p_partkey % 3] AS package, p_size % 6 AS x, '>=' || (p_partkey % 4) || '.0.0' AS spec FROM part)
SELECT fact, CASE WHEN NOT EXISTS (SELECT 1 FROM rel r WHERE r.u = t.u AND r.package = t.package AND r.x = t.x) THEN 'unpublished' ELSE 'not required' END AS problem FROM told t
WHERE NOT EXISTS (SELECT 1 FROM req q WHERE q.u = t.u AND q.package = t.package AND q.x = t.x AND q.target = 'b' AND q.spec = t.spec)""")
def pk_fact_problems(spark, sf_dir):
    """Each part tells that a release of its brand asks for b in a range; some releases and some ranges are not so."""
    releases, requirements, _ = universes(spark, sf_dir)
    owned = lambda c: F.concat_ws(":", F.col("universe").cast("string"), F.col(c)).alias(c)
    told = table(spark, sf_dir, "part").selectExpr("p_partkey AS fact", "CAST(substr(p_brand, 7) AS INT) AS universe", "element_at(array('a', 'b', 'c'), CAST(1 + p_partkey % 3 AS INT)) AS package",
                                                   "named_struct('major', CAST(p_size % 6 AS LONG), 'minor', 0L, 'patch', 0L) AS version", "'b' AS target", "concat('>=', p_partkey % 4, '.0.0') AS spec")
    facts = told.select("fact", owned("package"), "version", owned("target"), v.version_range(F.col("spec")).alias("range"))
    return pk.fact_problems(facts, releases.select(owned("package"), "version"), requirements.select(owned("package"), "version", owned("target"), "range"))


def _valid(spark, sf_dir):
    releases, requirements, roots = universes(spark, sf_dir)
    return pk.valid_assignments(pk.assignments(releases, "universe"), requirements, roots, "universe"), requirements, roots


@register("pk_all_solutions", SOLUTIONS + "SELECT u AS universe, 'a=' || xa || '.0.0 b=' || xb || '.0.0' || coalesce(' c=' || xc || '.0.0', '') AS chosen FROM valid")
def pk_all_solutions(spark, sf_dir):
    pairs = F.transform(F.array_sort(F.map_entries("chosen")), lambda e: F.concat(e["key"], F.lit("="), v.version_text(e["value"])))
    return _valid(spark, sf_dir)[0].select("universe", F.array_join(pairs, " ").alias("chosen"))


@register("pk_preferred", SOLUTIONS + CHOSEN)
def pk_preferred(spark, sf_dir):
    valid, requirements, roots = _valid(spark, sf_dir)
    return pk.preferred(valid, requirements, roots, "universe").select("universe", "package", v.version_text(F.col("version")).alias("version"))


@register("pk_solve", SOLUTIONS + f"SELECT universe, true AS solved, package, version FROM ({CHOSEN}) UNION ALL SELECT DISTINCT u, false, NULL, NULL FROM rel WHERE u NOT IN (SELECT u FROM valid)")
def pk_solve(spark, sf_dir):
    return solver.resolve(*universes(spark, sf_dir), "universe").drop("cause").distinct()


@register("pk_explain")
def pk_explain(spark, sf_dir):
    """universe, cause of the universes without a solution; the causes have none together and one without any of them."""
    return solver.resolve(*universes(spark, sf_dir), "universe").where("NOT solved").select("universe", "cause")


#: Explanations of the universes: all roots and requirements, one fact a release; those of u % 3 = 1 say nothing of b, of u % 4 = 2 cite a root on
#: c, and of u % 4 = 3 that a 0 asks for c >= 2.
@register("pk_explanation_problems", UNIVERSES + """
, told AS (
  SELECT u, 'root a' AS fact, NULL AS package, NULL AS x, 'a' AS target, CASE WHEN u % 5 = 0 THEN '==3.0.0' ELSE '*' END AS spec FROM (SELECT DISTINCT u FROM rel)
  UNION ALL SELECT DISTINCT u, 'root b', NULL, NULL, 'b', '<3.0.0' FROM rel WHERE u % 2 = 0
  UNION ALL SELECT DISTINCT u, 'root c', NULL, NULL, 'c', '*' FROM rel WHERE u % 4 = 2
  UNION ALL SELECT DISTINCT u, 'a 0 c>=2.0.0', 'a', 0, 'c', '>=2.0.0' FROM rel WHERE u % 4 = 3
  UNION ALL SELECT u, package || ' ' || x || ' ' || target || spec, package, x, target, spec FROM req),
facts AS (SELECT *, regexp_extract(spec, '^[^0-9]+') AS op, TRY_CAST(regexp_extract(spec, '([0-9]+)[.]', 1) AS INTEGER) AS n FROM told WHERE u % 3 <> 1 OR target <> 'b'),
early AS (SELECT u, 'E2' AS problem, fact FROM facts WHERE fact = 'root c' UNION ALL SELECT u, 'E3', fact FROM facts WHERE fact = 'a 0 c>=2.0.0' AND EXISTS (SELECT 1 FROM rel WHERE rel.u = facts.u AND rel.package = 'a' AND rel.x = 0)),
sound AS (SELECT DISTINCT u FROM rel WHERE u NOT IN (SELECT u FROM early)),
xs AS (SELECT DISTINCT u, package, x FROM rel UNION ALL SELECT DISTINCT u, package, NULL FROM (SELECT u FROM sound) CROSS JOIN (VALUES ('a'), ('b'), ('c')) t(package)),
choices AS (SELECT a.u, a.x AS xa, b.x AS xb, c.x AS xc FROM xs a JOIN xs b ON a.u = b.u AND b.package = 'b' JOIN xs c ON a.u = c.u AND c.package = 'c' JOIN sound s ON s.u = a.u WHERE a.package = 'a'),
held AS (
  SELECT u, xa, xb, xc, fact, (package IS NULL OR coalesce(CASE package WHEN 'a' THEN xa WHEN 'b' THEN xb ELSE xc END = x, false))
    AND NOT coalesce(CASE op WHEN '>=' THEN y >= n WHEN '<=' THEN y <= n WHEN '!=' THEN y <> n WHEN '==' THEN y = n WHEN '<' THEN y < n ELSE y IS NOT NULL END, false) AS broken
  FROM (SELECT c.u, xa, xb, xc, fact, f.package, f.x, op, n, CASE f.target WHEN 'a' THEN xa WHEN 'b' THEN xb ELSE xc END AS y FROM choices c JOIN facts f ON f.u = c.u)),
seen AS (SELECT DISTINCT u, one FROM (SELECT u, count(*) FILTER (broken) AS k, min(fact) FILTER (broken) AS one FROM held GROUP BY u, xa, xb, xc) WHERE k <= 1)
SELECT u AS universe, problem, fact FROM early UNION ALL SELECT u, 'E4', NULL FROM seen WHERE one IS NULL
UNION ALL SELECT f.u, 'E5', fact FROM facts f JOIN sound USING (u) WHERE f.u NOT IN (SELECT u FROM seen WHERE one IS NULL) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.u = f.u AND s.one = f.fact)""")
def pk_explanation_problems(spark, sf_dir):
    releases, requirements, roots = universes(spark, sf_dir)
    only = lambda x: v.version_range(F.concat(F.lit("=="), x.cast("string"), F.lit(".0.0")))
    none = F.lit(None).cast("string")
    cited = roots.select("universe", F.concat(F.lit("root "), F.col("target")).alias("fact"), none.alias("package"), F.when(F.lit(False), F.col("range")).alias("versions"), "target", "range")
    told = requirements.select("universe", F.concat_ws(" ", "package", F.col("version.major").cast("string"), F.concat("target", v.range_text(F.col("range")))).alias("fact"), "package", only(F.col("version.major")).alias("versions"), "target", "range")
    named = roots.select("universe").distinct()
    never = named.where("universe % 4 = 2").select("universe", F.lit("root c").alias("fact"), none.alias("package"), F.when(F.lit(False), v.version_range(F.lit("*"))).alias("versions"), F.lit("c").alias("target"), v.version_range(F.lit("*")).alias("range"))
    false = named.where("universe % 4 = 3").select("universe", F.lit("a 0 c>=2.0.0").alias("fact"), F.lit("a").alias("package"), only(F.lit(0)).alias("versions"), F.lit("c").alias("target"), v.version_range(F.lit(">=2.0.0")).alias("range"))
    facts = cited.unionByName(told).unionByName(never).unionByName(false).where("universe % 3 <> 1 OR target <> 'b'")
    return pk.explanation_problems(facts, releases, requirements, roots, "universe")

"""The range join against a check of every pair, with one package that has half of all releases and one range that half ask for."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import versions as v
from tessera.operators import constraints as pk

REQUIREMENTS = "asker string, target string, spec string"


def tables(seed=4, n=400):
    rng = random.Random(seed)
    releases = sorted({("hot" if i % 2 else f"p{rng.randrange(12)}", rng.randrange(12), rng.randrange(6), rng.randrange(4)) for i in range(n)})
    asks = []
    for i in range(300):
        comparators = [f"{rng.choice(['==', '!=', '>=', '<=', '>', '<', '!='])}{rng.randrange(13)}.{rng.randrange(7)}.{rng.randrange(5)}" for _ in range(rng.randint(0, 4))]
        asks.append((f"a{i}", rng.choice(["hot", "hot", "nowhere", f"p{rng.randrange(12)}"]), ",".join(comparators) or "*"))
    asks += [(f"same{i}", "hot", ">=2.0.0,!=3.1.0") for i in range(200)]
    asks += [("void", "hot", ">=5.0.0,<5.0.0"), ("empty", "hot", ">5.0.0,<3.0.0"), ("hole", "p1", "==1.0.0,!=1.0.0"), ("bad", "hot", "~1.0.0"), ("none", None, "*")]
    return releases, asks


def holds(version, spec):
    for c in [] if spec == "*" else spec.split(","):
        op = c[:2] if c[1] == "=" else c[:1]
        w = tuple(map(int, c[len(op) :].split(".")))
        if not {"==": version == w, "!=": version != w, ">=": version >= w, "<=": version <= w, ">": version > w, "<": version < w}[op]:
            return False
    return True


def frames(spark, releases, asks):
    made = spark.createDataFrame(releases, "package string, major long, minor long, patch long").select("package", F.struct("major", "minor", "patch").alias("version"))
    asked = spark.createDataFrame(asks, REQUIREMENTS).withColumn("range", v.version_range(F.col("spec")))
    return made.repartition(5), asked.repartition(3)


def expected(releases, asks):
    return sorted((a, t, s, (x, y, z)) for a, t, s in asks if not s.startswith("~") for p, x, y, z in releases if p == t and holds((x, y, z), s))


@pytest.mark.parametrize("bin_size, share", [(pk.BIN, pk.SPANS), (7, 5), (1, 1)])
def test_pairs(spark, bin_size, share):
    releases, asks = tables()
    made, asked = frames(spark, releases, asks)
    got = [(r.asker, r.target, r.spec, tuple(r.found)) for r in pk.matches(asked, made, bin_size, share).collect()]
    assert sorted(got) == expected(releases, asks)


def test_newest(spark):
    releases, asks = tables(9)
    made, asked = frames(spark, releases, asks)
    want = {}
    for a, _, _, version in expected(releases, asks):
        want[a] = max(want.get(a, version), version)
    got = {r.asker: r.newest and tuple(r.newest) for r in pk.newest_match(asked, made, ["asker"]).collect()}
    assert got == {a: want.get(a) for a, *_ in asks}


def test_repeated_releases_and_empty_tables(spark):
    releases, asks = tables(2, 60)
    made, asked = frames(spark, releases, asks)
    twice = sorted((r.asker, tuple(r.found)) for r in pk.matches(asked, made.unionByName(made)).collect())
    assert twice == sorted(2 * [(a, f) for a, _, _, f in expected(releases, asks)])
    assert pk.matches(asked.limit(0), made).collect() == [] and pk.matches(asked, made.limit(0)).collect() == []
    assert {r.newest for r in pk.newest_match(asked, made.limit(0), ["asker"]).collect()} == {None}


def test_no_task_holds_a_hot_package(spark):
    """Half of all releases are of one package, and all askers want all of it: every bin meets a bounded number of spans."""
    n = 20_000
    made = spark.range(n).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 50)).alias("package"), F.struct((F.col("id") % 7).alias("major"), F.col("id").alias("minor"), F.lit(0).cast("long").alias("patch")).alias("version"))
    asked = spark.range(40).select(F.concat(F.lit("a"), "id").alias("asker"), F.lit("hot").alias("target"), v.version_range(F.concat(F.lit(">=0.0.0,!=3."), F.col("id").cast("string"), F.lit(".0"))).alias("range"))
    asks, spans, placed = pk.ordinal_spans(asked, made)
    assert placed.count() == n and placed.select("ordinal").distinct().count() == n and placed.agg(F.max("ordinal")).first()[0] == n - 1
    assert 40 <= spans.count() <= 80
    counts = {r.asker: r["count"] for r in pk.matches(asked, made, 256, 8).groupBy("asker").count().collect()}
    assert len(counts) == 40 and set(counts.values()) <= {n // 2, n // 2 - 1} and len(set(counts.values())) == 2


def test_pairs_of_one_range_are_dealt(spark, monkeypatch):
    """Half of the askers have one range: its pairs come from many tasks; packages that nobody asks for are left out first."""
    monkeypatch.setattr(pk, "MADE", 2000)
    made = spark.range(400).select(F.when(F.col("id") < 100, "hot").otherwise("cold").alias("package"), F.struct(F.col("id").alias("major"), F.lit(0).cast("long").alias("minor"), F.lit(0).cast("long").alias("patch")).alias("version"))
    asked = spark.range(800).select("id", F.lit("hot").alias("target"), v.version_range(F.expr("IF(id % 2 = 0, '*', concat('>=', id % 90, '.0.0'))")).alias("range"))
    rows = pk.matches(asked, made)
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 400 * 100 + sum(100 - i % 90 for i in range(1, 800, 2)) and max(counts) < sum(counts) / 5
    assert pk._offered(asked, made).count() == 100


def test_a_learned_window_makes_pairs_for_sets_of_ranges(spark, monkeypatch):
    """300 releases that ask alike count as one; all ranges of a release must hold, and a release without a range admits nothing."""
    rows = [("a", i, 0, 0, "t", spec) for i in range(300) for spec in (">=1.0.0", "<4.0.0")] + [("b", 0, 0, 0, "t", "==6.0.0"), ("b", 1, 0, 0, "t", "bad"), ("c", 0, 0, 0, "t", "*")]
    asks = spark.createDataFrame(rows, "package string, major long, minor long, patch long, target string, spec string")
    asks = asks.select("package", F.struct("major", "minor", "patch").alias("version"), "target", v.version_range(F.col("spec")).alias("range"))
    made = spark.createDataFrame([("t", i, 0, 0) for i in range(9)] + [("c", i, 0, 0) for i in range(2)], "package string, major long, minor long, patch long").select("package", F.struct("major", "minor", "patch").alias("version"))
    made = made.unionByName(asks.where("package <> 'c'").select("package", "version").distinct())
    pairs, plain = [], pk.matches

    def counted(*args):
        pairs.append(plain(*args).count())
        return plain(*args)

    monkeypatch.setattr(pk, "matches", counted)
    got = {(r.package, r.target): [f.major for f in r.allowed] for r in pk.learned_window(made, asks).collect()}
    assert got == {("a", "t"): [1, 2, 3], ("b", "t"): [6]}
    assert sum(pairs) == 8 + 4 + 1

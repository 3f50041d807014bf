"""What must hold whatever the partitioning: same results, few tasks' worth of data in one place, pushed filters."""

from tessera.operators import incremental as im
from tessera.operators import versioned as kv
from tessera.operators.constraints import reach_doubling
from tessera.operators.numbering import numbered, running_sum
from tessera.plans.kv import event_log
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_numbering_is_a_global_row_number(spark):
    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 331 AS by")
    got = {r.id: r.n for r in numbered(rows.repartition(7), "n", F.col("by"), ["id"], ranges=9).collect()}
    want = {i: n for n, (_, i) in enumerate(sorted(((i * 7919) % 331, i) for i in range(1000)), 1)}
    assert got == want
    assert numbered(rows.limit(0), "n", F.col("by"), ["id"]).count() == 0
    sums = {r.id: r.s for r in running_sum(rows.repartition(3), "s", "by", "id", ranges=5).collect()}
    total = 0
    for i in range(1000):
        total += (i * 7919) % 331
        assert sums[i] == total


def test_snapshots_do_not_depend_on_partitioning(spark):
    log = event_log(spark, SF)
    a = sorted(map(tuple, kv.latest(log, 400).collect()))
    assert a == sorted(map(tuple, kv.latest(log.repartition(11), 400).collect()))
    pruned = kv.prune(log, 400)
    for at in (400, 700, 1000):
        assert sorted(map(tuple, kv.latest(pruned.select(log.columns), at).collect())) == sorted(map(tuple, kv.latest(log, at).collect()))


def test_filters_reach_the_scan(spark):
    plan = spark.read.parquet(f"{SF}/events.parquet").where("user_id = 7").select("value")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,7)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_deep_chain_needs_few_rounds(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    reach = reach_doubling(edges, n)
    assert reach.count() == n * (n + 1) // 2


def test_a_nan_is_always_a_change(spark):
    rows = spark.createDataFrame([(1, 1, float("nan")), (1, 2, float("nan")), (1, 3, 2.0), (1, 4, 2.0), (1, 5, None), (1, 6, None)], "key long, version long, value double")
    assert [r.changed for r in im.changes(rows).orderBy("version").collect()] == [True, True, True, False, True, False]

"""Stored traces: what runs and what does not, dynamic dependencies, early cutoff, cycles; and a walk against plain recursion."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.traces import CycleError, Traces

GRAPH = "node long, kind string, args array<long>"
INPUTS = "node long, value long, changed_at long"


def body():
    """sum adds all of args; tens adds them and drops the last digit; cond reads args[0] and then args[1] or args[2]."""
    total = F.aggregate("read", F.lit(0).cast("long"), lambda a, r: a + r.value)
    none = F.array().cast("array<long>")
    first = F.size("read") == 0
    chosen = F.when(F.get("read", F.lit(0))["value"] % 2 == 0, F.get("args", F.lit(1))).otherwise(F.get("args", F.lit(2)))
    wants = F.when(F.col("kind") == "cond", F.when(first, F.slice("args", 1, 1)).when(F.size("read") == 1, F.array(chosen)).otherwise(none)).otherwise(F.when(first & (F.size("args") > 0), F.col("args")).otherwise(none))
    value = F.when(F.col("kind") == "tens", F.expr("1") * (total - total % 10)).when(F.col("kind") == "cond", F.get("read", F.lit(1))["value"]).otherwise(total)
    return F.struct(wants.alias("wants"), value.alias("value"))


def plain(graph, values, node, ran):
    if node in values:
        return values[node]
    kind, args = graph[node]
    ran.add(node)
    if kind == "cond":
        return plain(graph, values, args[1] if plain(graph, values, args[0], ran) % 2 == 0 else args[2], ran)
    total = sum(plain(graph, values, a, ran) for a in args)
    return total - total % 10 if kind == "tens" else total


def test_reruns_only_what_a_change_reaches(spark, tmp_path):
    graph = {100: ("tens", [1, 2]), 101: ("tens", [3]), 102: ("cond", [4, 100, 101]), 103: ("sum", [102, 5]), 104: ("sum", [6])}
    traces = Traces(spark, str(tmp_path), body)
    traces.register(spark.createDataFrame([(n, k, a) for n, (k, a) in graph.items()], GRAPH))
    values = {i: 10 * i + 1 for i in range(1, 7)}
    changed = dict.fromkeys(values, 0)
    asked = spark.createDataFrame([(103,)], "node long")

    def verify(revision, **_):
        inputs = spark.createDataFrame([(i, v, changed[i]) for i, v in values.items()], INPUTS)
        rows = {r.node: (r.value, r.ran) for r in traces.verify(asked, inputs, revision, revision - 1).collect()}
        assert rows[103][0] == plain(graph, values, 103, set())
        assert traces.executed == sum(r for _, r in rows.values())
        return {n for n, (_, r) in rows.items() if r}, set(rows)

    assert verify(1) == ({101, 102, 103}, {101, 102, 103})  # 4 is odd: 100 is not read, 104 is not asked for
    assert verify(2) == (set(), {101, 102, 103})
    values[1], changed[1] = 99, 3  # nothing reads it now
    assert verify(3) == (set(), {101, 102, 103})
    values[3], changed[3] = 32, 4  # 101 is 30 as before: early cutoff
    assert verify(4) == ({101}, {101, 102, 103})
    values[4], changed[4] = 40, 5  # even: 100 is read for the first time, 101 no more
    assert verify(5) == ({100, 102, 103}, {100, 102, 103})
    values[3], changed[3] = 777, 6
    assert verify(6) == (set(), {100, 102, 103})
    assert {(r.step, r.dep) for r in traces.steps(6).where("node = 102").collect()} == {(0, 4), (1, 100)}


def test_cycles_and_unknown_nodes(spark, tmp_path):
    inputs = spark.createDataFrame([(1, 1, 0)], INPUTS)
    asked = spark.createDataFrame([(9,)], "node long")
    loop = Traces(spark, f"{tmp_path}/a", body)
    loop.register(spark.createDataFrame([(9, "sum", [10, 1]), (10, "sum", [11]), (11, "sum", [10])], GRAPH))
    with pytest.raises(CycleError) as e:
        loop.verify(asked, inputs, 1, 0)
    assert e.value.path == [10, 11, 10]
    lost = Traces(spark, f"{tmp_path}/b", body)
    lost.register(spark.createDataFrame([(9, "sum", [77])], GRAPH))
    with pytest.raises(KeyError):
        lost.verify(asked, inputs, 1, 0)


def test_random_graphs(spark, tmp_path):
    rng = random.Random(12)
    graph = {n: (k := rng.choice(["sum", "tens", "cond"]), [rng.choice([*range(8), *range(100, n)]) for _ in range(3 if k == "cond" else rng.randint(1, 4))]) for n in range(100, 125)}
    traces = Traces(spark, str(tmp_path), body)
    traces.register(spark.createDataFrame([(n, k, a) for n, (k, a) in graph.items()], GRAPH))
    values, changed = {i: rng.randrange(50) for i in range(8)}, dict.fromkeys(range(8), 0)
    for revision in (1, 2):
        for i in rng.sample(range(8), 3) if revision > 1 else []:
            values[i], changed[i] = rng.randrange(50), revision
        asked = [124, 123]
        rows = {r.node: r for r in traces.verify(spark.createDataFrame([(a,) for a in asked], "node long"), spark.createDataFrame([(i, v, changed[i]) for i, v in values.items()], INPUTS), revision, revision - 1).collect()}
        reached = set()
        assert all(rows[a].value == plain(graph, values, a, reached) for a in asked)
        assert reached <= set(rows) and (revision > 1 or reached == {n for n, r in rows.items() if r.ran})


@pytest.mark.parametrize("few", [0, 100_000])
def test_a_level_takes_two_rounds_at_most(spark, tmp_path, monkeypatch, few):
    """What a node reads first is looked up in the round in which it starts, by broadcast or by shuffle; what waits only learns of what ends."""
    monkeypatch.setattr("tessera.operators.traces.FEW", few, raising=False)
    traces = Traces(spark, str(tmp_path), body)
    traces.register(spark.createDataFrame([(103, "sum", [102, 5]), (102, "sum", [100, 101, 100]), (101, "tens", [3]), (100, "tens", [1, 2])], GRAPH))
    values, changed = {i: 10 * i + 1 for i in range(1, 6)}, dict.fromkeys(range(1, 6), 0)

    def verify(revision, asked=(103,)):
        inputs = spark.createDataFrame([(i, v, changed[i]) for i, v in values.items()], INPUTS)
        return {r.node: (r.value, r.ran) for r in traces.verify(spark.createDataFrame([(a,) for a in asked], "node long"), inputs, revision, revision - 1).collect()}

    assert verify(1) == {100: (30, True), 101: (30, True), 102: (90, True), 103: (141, True)}
    assert traces.rounds <= 5 and traces.executed == 4
    values[1], changed[1] = 21, 2
    assert verify(2) == {100: (40, True), 101: (30, False), 102: (110, True), 103: (161, True)}
    assert traces.executed == 3 and traces.rounds <= 8
    assert verify(3, asked=()) == {} and traces.rounds == 0

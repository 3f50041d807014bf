"""Dataflow graphs: outcomes against plain recursion on random graphs, errors, cycles and unknown args."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.dataflow import KINDS, disagreements, evaluate
from tessera.synth.graphs import random_graphs

GRAPH = "node long, kind string, args array<long>, m long, handles boolean"


class Failed(Exception):
    pass


def plain(graph, values, node):
    """The value of a node by recursion, or Failed."""
    if node in values:
        if values[node] is None:
            raise Failed("none")
        return values[node]
    kind, args, m, handles = graph[node]

    def read(k):
        try:
            return plain(graph, values, args[k])
        except Failed as e:
            if not handles:
                raise
            return -len(str(e))

    if kind in ("sum", "raise"):
        total = sum([read(k) for k in range(len(args))])
        if kind == "raise" and total % 3 == 0:
            raise Failed(f"bad-{total % 2}")
        return total % m
    head = read(0)
    if kind == "cond":
        return read(1 if head % 2 == 0 else 2) % m
    if kind == "select":
        return read(1 + head % (len(args) - 1)) % m
    return head if head % 3 == 0 else (head + sum([read(k) for k in range(1, len(args))])) % m


def outcome(graph, values, node):
    try:
        return plain(graph, values, node), None
    except Failed as e:
        return None, str(e)


def test_random_graphs(spark):
    inputs, nodes = (df.cache() for df in random_graphs(spark, 120, seed=7))
    graph = {r.node: (r.kind, r["args"], r.m, r.handles) for r in nodes.collect()}
    values = {r.node: r.value for r in inputs.collect()}
    got = {r.node: (r.value, r.error) for r in evaluate(nodes, inputs).collect()}
    want = {n: outcome(graph, values, n) for n in graph}
    assert got == want and {r[0] for r in graph.values()} == set(KINDS)
    assert {e for _, e in want.values()} == {None, "bad-0", "bad-1"}
    # another engine with one wrong value and one missing node
    some = sorted(graph)[5:7]
    rows = [(n, (v or 0) + 1 if n == some[0] else v, None if n == some[0] else e) for n, (v, e) in want.items() if n != some[1]]
    off = disagreements(nodes, inputs, spark.createDataFrame(rows, "node long, value long, error string")).collect()
    assert sorted(r.node for r in off) == some


def test_graphs_do_not_depend_on_partitions(spark):
    a, b = random_graphs(spark, 30, seed=3), random_graphs(spark, 30, seed=3)
    assert sorted(map(str, a[1].collect())) == sorted(map(str, b[1].repartition(3).collect()))
    assert sorted(map(str, a[1].collect())) != sorted(map(str, random_graphs(spark, 30, seed=4)[1].collect()))
    assert a[1].where(F.exists("args", lambda x: x >= F.col("node"))).count() == 0


def test_what_is_not_read_has_no_say(spark):
    rows = [(10, "raise", [1, 1], 5, False), (11, "cond", [2, 1, 10], 5, False), (12, "cond", [3, 1, 10], 5, False), (13, "sum", [10, 2], 5, True), (14, "guard", [1, 10], 5, False), (15, "sum", [4, 10], 5, False)]
    inputs = spark.createDataFrame([(1, 3), (2, 2), (3, 7), (4, None)], "node long, value long")
    got = {r.node: (r.value, r.error) for r in evaluate(spark.createDataFrame(rows, GRAPH), inputs).collect()}
    assert got == {10: (None, "bad-0"), 11: (3, None), 12: (None, "bad-0"), 13: (2, None), 14: (3, None), 15: (None, "none")}


def test_cycles_and_unknown_args(spark):
    inputs = spark.createDataFrame([(1, 3)], "node long, value long")
    for args in ([2, 1], [99, 1]):
        with pytest.raises(ValueError, match="node 2 reads"):
            evaluate(spark.createDataFrame([(2, "sum", args, 5, False)], GRAPH), inputs)
    assert evaluate(spark.createDataFrame([], GRAPH), inputs).collect() == []

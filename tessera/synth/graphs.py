"""Random dataflow graphs as tables, for tests of engines that evaluate them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.dataflow import KINDS

#: Inputs and nodes that a graph may have; node ids are graph * SLOTS + place, inputs first.
INPUTS, NODES, SLOTS = (3, 6), (10, 17), 64


def _draw(low: int | Column, high: int | Column, *named: Column | int | str) -> Column:
    """A number from low to high, both included, that the names decide."""
    named = [F.lit(x) if isinstance(x, int | str) else x for x in named]
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (low + F.pmod(F.xxhash64(*named), high - low + 1)).cast("long")


def random_graphs(spark: SparkSession, graphs: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """inputs (graph, node, value) and nodes (graph, node, kind, args, m, handles) of graphs without cycles: a node's args are
    inputs or nodes before it; equal seeds give equal graphs, however Spark deals the rows."""
    made = spark.range(graphs).select(F.col("id").alias("graph")).withColumn("inputs", _draw(*INPUTS, seed, F.col("graph"), "inputs"))
    made = made.withColumn("nodes", _draw(*NODES, seed, F.col("graph"), "nodes"))
    base = F.col("graph") * SLOTS
    inputs = made.select("graph", F.explode(F.expr("sequence(0L, inputs - 1)")).alias("at")).select("graph", (base + F.col("at")).alias("node"), _draw(0, 11, seed, F.col("graph"), F.col("at"), "value").alias("value"))
    rows = made.select("graph", "inputs", F.explode(F.expr("sequence(inputs, inputs + nodes - 1)")).alias("at"))
    own = [seed, F.col("graph"), F.col("at")]
    rows = rows.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), _draw(1, len(KINDS), *own, "kind").cast("int")))
    count = F.when(F.col("kind") == "cond", 3).when(F.col("kind") == "select", _draw(3, 5, *own, "n")).otherwise(_draw(2, 4, *own, "n"))
    args = F.transform(F.sequence(F.lit(1).cast("long"), count.cast("long")), lambda k: base + _draw(0, F.col("at") - 1, *own, k, "arg"))
    return inputs, rows.select("graph", (base + F.col("at")).alias("node"), "kind", args.alias("args"), _draw(2, 5, *own, "m").alias("m"), (_draw(0, 3, *own, "h") == 0).alias("handles"))

"""Graphs of small bodies evaluated level by level, with errors as outcomes.

Nodes are node, kind, args (array of node ids, inputs or nodes), m and handles; inputs are node and value. An outcome is a
struct of value and error, of which one is null. What a body reads it reads in the order of its args, and the first error read is
its own outcome; a node that `handles` errors reads minus the length of the error's text in place of it. An arg that a
body does not read has no say. Kinds:

    sum     all args added, modulo m
    cond    the second arg if the first one is even, else the third, modulo m
    select  the arg that the first one points to, counted around among the rest, modulo m
    guard   the first arg as it is if it is divisible by 3, else all args added, modulo m
    raise   as sum, but an error `bad-0` or `bad-1` if the sum is divisible by 3

Remainders are never negative. All bodies are column expressions. A round evaluates every node whose args are all known, so a
graph takes as many rounds as it has levels; edges to what is known are resolved once and leave the loop's joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.incremental import difference
from tessera.operators.lineage import cut

KINDS = ("sum", "cond", "select", "guard", "raise")
OUTCOME = "struct<value:bigint,error:string>"


def _outcome(value: Column, error: Column | None = None) -> Column:
    return F.struct(value.cast("long").alias("value"), (F.lit(None) if error is None else error).cast("string").alias("error"))


def _total(read: Column) -> Column:
    """All outcomes added; the first error, if there is one."""
    failed = F.get(F.filter(read, lambda r: r["error"].isNotNull()), F.lit(0))
    total = F.aggregate(read, F.lit(0).cast("long"), lambda a, r: a + F.coalesce(r["value"], F.lit(0).cast("long")))
    return F.when(failed.isNotNull(), failed).otherwise(_outcome(total))


def _reduced(of: Column, m: Column) -> Column:
    return F.when(of["error"].isNotNull(), of).otherwise(_outcome(F.pmod(of["value"], m)))


def body(kind: Column, read: Column, m: Column) -> Column:
    """The outcome of a node whose args have the outcomes `read`, errors handled already."""
    first, rest = F.get(read, F.lit(0)), F.size(read) - 1
    total, head = _total(read), first["value"]
    chosen = F.when(F.pmod(head, F.lit(2)) == 0, F.get(read, F.lit(1))).otherwise(F.get(read, F.lit(2)))
    picked = F.get(read, (F.pmod(head, F.greatest(rest, F.lit(1))) + 1).cast("int"))
    fails = (kind == "raise") & total["error"].isNull() & (F.pmod(total["value"], F.lit(3)) == 0)
    early = (kind != "sum") & (kind != "raise") & first["error"].isNotNull()
    return (
        F.when(early, first)
        .when(kind == "cond", _reduced(chosen, m))
        .when(kind == "select", _reduced(picked, m))
        .when((kind == "guard") & (F.pmod(head, F.lit(3)) == 0), first)
        .when(fails, _outcome(F.lit(None), F.concat(F.lit("bad-"), F.pmod(total["value"], F.lit(2)).cast("string"))))
        .otherwise(_reduced(total, m))
    )


def evaluate(nodes: DataFrame, inputs: DataFrame) -> DataFrame:
    """node, value, error of every node; ValueError if nodes rest on a cycle or on what is neither a node nor an input.

    Null values of inputs are an error `none` of theirs. Nodes and inputs are each named once.
    """
    given = F.when(F.col("value").isNull(), F.lit("none"))
    known = inputs.select(F.col("node").alias("dep"), _outcome(F.col("value"), given).alias("got"))
    waiting = cut(nodes.select("node", "kind", "m", "handles", F.size("args").alias("n"), F.posexplode("args").alias("pos", "dep")))
    resolved, done = None, None
    while True:
        met = cut(waiting.join(known, "dep", "left"))
        waiting = met.where("got IS NULL").drop("got")
        new = met.where("got IS NOT NULL").drop("dep")
        resolved = new if resolved is None else resolved.unionByName(new)
        by = resolved.groupBy("node", "kind", "m", "handles", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "got"))).alias("r"))
        tamed = lambda r: F.when(F.col("handles") & r["got"]["error"].isNotNull(), _outcome(-F.length(r["got"]["error"]))).otherwise(r["got"])
        ready = by.where("size(r) = n").withColumn("read", F.transform("r", tamed))
        fresh = cut(ready.select("node", body(F.col("kind"), F.col("read"), F.col("m")).alias("got")))
        if not fresh.limit(1).count():
            break
        done = fresh if done is None else done.unionByName(fresh)
        known = fresh.withColumnRenamed("node", "dep")
        resolved = cut(resolved.join(fresh.select("node"), "node", "left_anti"))
    if waiting.limit(1).count():
        row = waiting.orderBy("node", "pos").first()
        raise ValueError(f"node {row['node']} reads {row['dep']}, which rests on a cycle or is unknown")
    done = fresh if done is None else done
    return done.select("node", "got.value", "got.error")


def disagreements(nodes: DataFrame, inputs: DataFrame, engine: DataFrame) -> DataFrame:
    """node, model, engine: where another engine's outcomes (node, value, error) differ from those of `evaluate`."""
    whole = lambda df: df.select("node", F.struct(F.col("value").cast("long").alias("value"), "error").alias("got"))
    return difference(whole(evaluate(nodes, inputs)), whole(engine), ["node"], "got")

"""Demand-driven recomputation over stored traces, with dynamic dependencies and early cutoff.

A graph has inputs (node, value, changed_at) and nodes (node, kind, args: an array of node ids). What a node reads is
decided by its body, a column expression over node, kind, args and `read`, the (dep, value) pairs read so far: it gives
`wants`, the nodes to read next, or, with empty `wants`, the node's `value`. So a body can choose what it reads by what it has
read. All ids and values are longs.

A trace tells, for each node, its value, when that last changed, up to which revision it was verified, and the
dependencies it read, in steps: what was wanted together is a step. Traces are Parquet tables of a folder, one version for each
revision.

`verify` brings the asked nodes, and what they rest on, to a revision. All nodes that are at work move on together, a step a
round: a node with a trace goes through its recorded steps, the next one only when all of the step before are verified; if
one of them has changed since the node was verified, its body runs anew, else the node is verified without
running. A node that runs to the value that it had keeps its changed_at, so nothing above it runs (early cutoff). A node that nobody
asks for is never looked at, and each node is at work once. When no node can move, those left rest on a cycle, which is an error that
names one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.incremental import components, witnesses
from tessera.operators.lineage import cut

NODES = "node long, kind string, args array<long>, value long, changed_at long, verified_at long"
STEPS = "node long, step int, pos int, dep long"
READ = "array<struct<dep:bigint,value:bigint>>"


#: Rows of ids up to which they are broadcast; above, both sides of a join are shuffled.
FEW = 100_000


def _near(rows: DataFrame, n: int) -> DataFrame:
    """`rows` of which there are n, broadcast if these are few."""
    return F.broadcast(rows) if n <= FEW else rows


class CycleError(ValueError):
    """Nodes rest on themselves; `path` is such a cycle."""

    def __init__(self, path: list[int]) -> None:
        super().__init__(f"cycle: {' > '.join(map(str, path))}")
        self.path = path


class Traces:
    """The traces of a graph, in a folder that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str, body: Callable[[], Column]) -> None:
        """`body` gives a struct of wants (array of longs) and value (long)."""
        self.spark, self.folder, self.body = spark, folder.rstrip("/"), body
        self.executed = self.rounds = 0

    def nodes(self, revision: int) -> DataFrame:
        """node, kind, args, value, changed_at, verified_at; value is null where a node has never been verified."""
        return self.spark.read.schema(NODES).parquet(f"{self.folder}/nodes/revision={revision}")

    def steps(self, revision: int) -> DataFrame:
        """node, step, pos, dep: what each node has read."""
        return self.spark.read.schema(STEPS).parquet(f"{self.folder}/steps/revision={revision}")

    def _write(self, nodes: DataFrame, steps: DataFrame, revision: int) -> None:
        nodes.write.mode("overwrite").parquet(f"{self.folder}/nodes/revision={revision}")
        steps.write.mode("overwrite").parquet(f"{self.folder}/steps/revision={revision}")

    def register(self, nodes: DataFrame, revision: int = 0) -> None:
        """The first version: nodes (node, kind, args) without traces."""
        none = F.lit(None).cast("long")
        self._write(nodes.select("node", "kind", "args", none.alias("value"), none.alias("changed_at"), none.alias("verified_at")), self.spark.createDataFrame([], STEPS), revision)

    def verify(self, asked: DataFrame, inputs: DataFrame, revision: int, before: int) -> DataFrame:
        """node, value, changed_at, ran of all that was looked at; the traces of version `before` go on as `revision`."""
        old, recorded = self.nodes(before), self.steps(before)
        last = cut(recorded.groupBy("node").agg(F.max("step").alias("last")))
        facts = inputs.select(F.col("node").alias("dep"), "value", "changed_at")
        empty = F.array().cast(READ)
        nothing = F.array().cast("array<long>")
        never = F.array().cast("array<array<bigint>>")

        def begun(wanted: DataFrame, n: int) -> DataFrame:
            """The state of `wanted`, n distinct nodes that start: through their trace if they have one, else by running, which
            gives what they read first. `fresh` are nodes whose needs have not been looked up."""
            traced = last if n > FEW else last.join(F.broadcast(wanted), "node")
            rows = old.join(_near(wanted, n), "node").join(traced, "node", "left")
            rows = rows.select("node", "kind", "args", F.col("value").alias("was"), "changed_at", "verified_at", F.coalesce("last", F.lit(-1)).alias("last"),
                               F.col("verified_at").isNull().alias("runs"), F.lit(0).alias("step"), empty.alias("read"), never.alias("asked"))
            did = rows.withColumn("did", F.when(F.col("runs"), self.body()))
            return did.withColumn("wants", F.coalesce("did.wants", nothing)).withColumn("fresh", F.lit(True)).drop("did")

        def counted(rows: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
            seen = Observation()
            rows = cut(rows.observe(seen, *(c.alias(name) for name, c in counts.items())))
            return rows, seen.get

        def looked_up(fresh: DataFrame, n: int) -> DataFrame:
            """What each of n nodes needs now: its recorded step, or what its body wants; `ready` where that is known."""
            steps = recorded.join(_near(fresh.where("NOT runs").select("node", "step"), n), ["node", "step"]).select("node", "pos", "dep", F.lit(False).alias("runs"))
            needs = steps.unionByName(fresh.where("runs").select("node", F.posexplode("wants").alias("pos", "dep"), F.lit(True).alias("runs")))
            known = facts.withColumn("ready", F.lit(True))
            if n <= FEW:
                needs, size = counted(needs, n=F.count(F.lit(1)))
                if size["n"] <= FEW:
                    known = known.join(F.broadcast(needs.select("dep").distinct()), "dep", "left_semi")
            return needs.join(known, "dep", "left").withColumn("fresh", F.lit(True))

        one = F.count(F.lit(1))
        active, size = counted(asked.select("node").distinct(), n=one)
        active, left = counted(begun(active, size["n"]), n=one, fresh=one)
        finished, pending, new, n_new, self.executed, self.rounds = None, None, None, 0, 0, 0
        while left["n"]:
            self.rounds += 1
            # what nodes wait for is looked up once; after that only what has just finished is new to them
            needs = pending
            if pending is not None and n_new:
                told = new.select(F.col("node").alias("dep"), F.col("value").alias("__value"), F.col("changed_at").alias("__changed"), F.lit(True).alias("__ready"))
                needs = pending.join(_near(told, n_new), "dep", "left").select("dep", "node", "pos", "runs", F.coalesce("value", "__value").alias("value"), F.coalesce("changed_at", "__changed").alias("changed_at"), F.coalesce("ready", "__ready").alias("ready"), "fresh")
            if left["fresh"]:
                found = looked_up(active.where("fresh"), left["fresh"])
                needs = found if needs is None else needs.unionByName(found)
            needs, lacks = counted(needs, n=F.count_if(F.col("fresh") & F.col("ready").isNull()))
            got = F.sort_array(F.collect_list(F.when(F.col("runs"), F.struct("pos", "dep", "value"))))
            by = needs.groupBy("node").agg(F.count_if(F.col("ready").isNull()).alias("missing"), F.max("changed_at").alias("newest"), got.alias("got"))
            waits = F.coalesce(F.col("missing") > 0, F.lit(False))
            changed = ~waits & ~F.col("runs") & F.coalesce(F.col("newest") > F.col("verified_at"), F.lit(False))
            state = F.when(waits, "wait").when(F.col("runs") | changed, "ran").when(F.col("step") + 1 > F.col("last"), "green").otherwise("step")
            seen = active.join(by, "node", "left").withColumns({"state": state, "changed": changed})
            # a body runs with all that it has read, from nothing after a change; what it has just read is a new step
            ran, anew = F.col("state") == "ran", F.col("changed")
            more = F.concat("read", F.coalesce(F.transform("got", lambda g: F.struct(g.dep.alias("dep"), g.value.alias("value"))), empty))
            seen = seen.withColumns({
                "read": F.when(anew, empty).when(ran, more).otherwise(F.col("read")),
                "asked": F.when(anew, never).when(ran & (F.size("wants") > 0), F.concat("asked", F.array("wants"))).otherwise(F.col("asked")),
                "step": F.when(anew, 0).when(F.col("state") == "step", F.col("step") + 1).otherwise(F.col("step")),
                "runs": F.col("runs") | anew,
            })
            seen = seen.drop("missing", "newest", "got", "changed").withColumn("did", F.when(ran, self.body()))
            wanted = F.coalesce("did.wants", nothing)
            seen = seen.withColumn("state", F.when(~ran, F.col("state")).when(F.size(wanted) == 0, "red").otherwise("more"))
            seen = seen.withColumns({"wants": F.when(F.col("state") == "more", wanted).otherwise(F.col("wants")), "value": F.col("did.value")}).drop("did")
            seen, is_ = counted(seen, wait=F.count_if(F.col("state") == "wait"), red=F.count_if(F.col("state") == "red"), green=F.count_if(F.col("state") == "green"))
            self.executed += is_["red"]
            n_new = is_["red"] + is_["green"]
            if n_new:
                red = F.col("state") == "red"
                same = F.col("value").eqNullSafe(F.col("was")) & F.col("verified_at").isNotNull()
                new = seen.where("state IN ('red', 'green')").select("node", F.when(red, F.col("value")).otherwise(F.col("was")).alias("value"), F.when(red & ~same, F.lit(revision)).otherwise(F.col("changed_at")).cast("long").alias("changed_at"), red.alias("ran"), "asked")
                new = cut(new)
                finished = new if finished is None else finished.unionByName(new)
                finished = cut(finished) if self.rounds % 16 == 0 else finished
                facts = inputs.select(F.col("node").alias("dep"), "value", "changed_at").unionByName(finished.select(F.col("node").alias("dep"), "value", "changed_at"))
            pending = needs.withColumn("fresh", F.lit(False)).join(_near(seen.where("state = 'wait'").select("node"), is_["wait"]), "node", "left_semi") if is_["wait"] else None
            going = seen.where("state IN ('wait', 'step', 'more')").withColumn("fresh", F.col("state") != "wait").select(*active.columns)
            n_going = left["n"] - n_new
            # only what a node needs now is started; it is started once
            if lacks["n"]:
                start = needs.where("fresh AND ready IS NULL").select(F.col("dep").alias("node")).distinct().join(_near(active.select("node"), left["n"]), "node", "left_anti")
                going = going.unionByName(begun(start, lacks["n"]).select(*active.columns))
            active, left = counted(going, n=one, fresh=F.count_if("fresh"))
            if not n_new and left["n"] == n_going == is_["wait"]:
                self._stuck(needs.where("ready IS NULL").select("node", "dep"), old)
        if finished is None:
            finished = self.spark.createDataFrame([], "node long, value long, changed_at long, ran boolean, asked array<array<bigint>>")
        self._record(finished, old, recorded, revision)
        return finished.select("node", "value", "changed_at", "ran")

    def _stuck(self, waiting: DataFrame, old: DataFrame) -> None:
        unknown = waiting.join(old.select(F.col("node").alias("dep")), "dep", "left_anti").first()
        if unknown:
            raise KeyError(f"node {unknown['node']} reads {unknown['dep']}, which is neither an input nor a node")
        held = cut(components(waiting))
        raise CycleError(witnesses(waiting, held).orderBy("component").first().path)

    def _record(self, finished: DataFrame, old: DataFrame, recorded: DataFrame, revision: int) -> None:
        """The next version: what ran has new steps, what was looked at is verified, all else stays as it is."""
        told = finished.select("node", F.col("value").alias("__value"), F.col("changed_at").alias("__changed"), F.lit(True).alias("__seen"))
        nodes = old.join(told, "node", "left").select("node", "kind", "args", F.when(F.col("__seen"), F.col("__value")).otherwise(F.col("value")).alias("value"),
                                                       F.coalesce("__changed", "changed_at").alias("changed_at"), F.when(F.col("__seen"), F.lit(revision)).otherwise(F.col("verified_at")).cast("long").alias("verified_at"))
        ran = finished.where("ran")
        made = ran.select("node", F.posexplode("asked").alias("step", "deps")).select("node", "step", F.posexplode("deps").alias("pos", "dep"))
        self._write(nodes, recorded.join(ran, "node", "left_anti").select("node", "step", "pos", "dep").unionByName(made), revision)

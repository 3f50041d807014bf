"""Incremental computation over changing inputs: revisions, change propagation with early cutoff, dependency graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.operators.lineage import cut
from tessera.operators.numbering import last_known, previous, running_sum


def changes(writes: DataFrame, value: str = "value") -> DataFrame:
    """Writes (key, version, value) with `changed`: whether the value differs from the key's last one, null-safe.

    A NaN never equals the value before it, so it always counts as a change.
    """
    rows = previous(writes, "__before", "key", "version", F.struct(F.col(value).alias("v")))
    same = F.col("__before").isNotNull() & F.col(value).eqNullSafe(F.col("__before.v"))
    if dict(writes.dtypes)[value] in ("double", "float"):
        same = same & ~F.coalesce(F.isnan(value), F.lit(False))
    return rows.withColumn("changed", ~same).drop("__before")


def revisions(writes: DataFrame, value: str = "value") -> DataFrame:
    """Writes with the revision after them, which only real changes move on, and the key's changed_at."""
    rows = changes(writes, value).withColumn("__one", F.col("changed").cast("long"))
    rows = running_sum(rows, "revision", "__one", "version").drop("__one")
    # revisions grow with versions, so the key's last change has its largest one
    return last_known(rows, "changed_at", "key", "version", F.when(F.col("changed"), F.col("revision")))


def first_changed_dependency(deps: DataFrame) -> DataFrame:
    """node, dep of deps (node, pos, dep, changed_at, verified_at): the first one, in recorded order, that has
    changed since the node was verified; nodes without such one are missing."""
    return deps.where(F.col("changed_at") > F.col("verified_at")).groupBy("node").agg(F.min_by("dep", "pos").alias("dep"))


def affected(changed: DataFrame, steps: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """The keys that a change reaches, level by level: each step maps a key column to the next level's."""
    out, keys = [], changed
    for table, key, up in steps:
        keys = table.join(keys.withColumnRenamed(keys.columns[0], "__key"), F.col(key) == F.col("__key"), "left_semi").select(up).distinct()
        out.append(keys)
    return out


def cutoff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of recomputed values that differ from the old ones; the others stop the propagation."""
    was = old.select(F.col(key).alias("__key"), F.col(value).alias("__was"))
    return new.join(was, F.col(key) == F.col("__key"), "left").where(~F.col(value).eqNullSafe(F.col("__was"))).select(key, value)


def hierarchy(rows: DataFrame, leaf: str, value: Column, fan_out: int, levels: int) -> DataFrame:
    """level, node, total: sums of leaves over groups of fan_out, fan_out^2 ...; each level is made of the one below."""
    below = rows.groupBy(F.col(leaf).alias("node")).agg(F.sum(value).alias("total"))
    out = None
    for level in range(1, levels + 1):
        below = below.groupBy(F.floor(F.col("node") / fan_out).cast("long").alias("node")).agg(F.sum("total").alias("total"))
        part = below.select(F.lit(level).alias("level"), "node", "total")
        out = part if out is None else out.unionByName(part)
    return out


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node: nodes (node) less those that depend, over any number of edges (node, dep), on a missing one.

    Pointer jumping: an edge to a node that itself rests on one other only is led on to that other one, so chains shorten by
    half in each round, and only the edges of nodes that are still open are kept, never all pairs of a closure. A node is
    good when no edge of it is left, bad when an edge leads to a bad one. When a round settles no node, what is left
    rests on cycles only and stays. Repeated edges count once, and an edge of a node to itself does not count.

    Before that, chains of neighbours by `node` are followed in blocks (`contracted`), so only what leaves a block takes rounds.
    """
    # one row a node: no edge, one edge, or, as `many`, more of them or one to null
    links = edges.where("NOT node <=> dep").select("node", "dep", F.lit(False).alias("here"))
    rows = nodes.select("node", F.lit(None).cast(dict(edges.dtypes)["dep"]).alias("dep"), F.lit(True).alias("here")).unionByName(links)
    lost = F.max(F.col("dep").isNull() & ~F.col("here"))
    rows = rows.groupBy("node").agg(F.max("here").alias("here"), F.min("dep").alias("dep"), (lost | F.coalesce(F.min("dep") < F.max("dep"), F.lit(False))).alias("many"))
    present = cut(contracted(rows.where("here AND node IS NOT NULL").select("node", "dep", "many")))
    many = present.where("state = 'many'").select("node")
    open_ = cut(present.where("state = 'open'").select("node", "dep").unionByName(edges.where("NOT node <=> dep").select("node", "dep").distinct().join(many, "node", "left_semi")))
    # few nodes are asked for where most are settled in their blocks
    goals = open_.select("dep").distinct()
    goals = cut(present.select(F.col("node").alias("dep"), "state").join(goals, "dep"))
    open_ = cut(open_.join(goals, "dep", "left").select("node", "dep", F.coalesce("state", F.lit("bad")).alias("state")))
    bad = cut(open_.where("state = 'bad'").select("node").distinct())
    open_ = cut(open_.where("state IN ('open', 'many')").select("node", "dep").join(bad, "node", "left_anti"))
    if open_.limit(1).count():
        bad = _fallen(open_, bad)
    stay = present.where("state = 'good'").select("node").unionByName(present.where("state IN ('open', 'many')").select("node").join(bad, "node", "left_anti"))
    return stay.unionByName(nodes.where("node IS NULL").select("node").distinct())


def contracted(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """node, dep, state of `rows` (node, dep, many; one for each node, dep null where it rests on none).

    Nodes are dealt by ranges, and in a block of neighbours each chain is followed to its end. Where that is a node without edges or
    a cycle, a node is good; where it is a node missing from the block's range, bad; else open, and `dep` is the end: a node
    of another block, or one that is `many`.
    """
    if ranges is None:
        ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = dict(rows.dtypes)["node"]
    alone = F.col("dep").isNotNull() & ~F.col("many")
    # no nulls, which pandas would make floats of
    flat = rows.select("node", F.when(alone, F.col("dep")).otherwise(F.col("node")).alias("dep"), F.when(F.col("many"), 2).when(alone, 1).otherwise(0).alias("kind"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in gathered(batches, BLOCK):
            node, dep, what = (pdf[c].to_numpy() for c in ("node", "dep", "kind"))
            own = np.arange(len(node))
            at = np.minimum(np.searchsorted(node, dep), len(node) - 1)
            inside = (what == 1) & (node[at] == dep)
            missing = (what == 1) & ~inside & (dep >= node[0]) & (dep <= node[-1])
            step = np.where(inside, at, own)
            end = step
            for _ in range(len(node).bit_length()):
                end = end[end]
            state = np.select([inside[end] | (what[end] == 0), missing[end], what == 2], ["good", "bad", "many"], "open")
            yield pd.DataFrame({"node": node, "dep": np.where(what[end] == 2, node[end], dep[end]), "state": state})

    return flat.repartitionByRange(ranges, "node").sortWithinPartitions("node").mapInPandas(follow, f"node {kind}, dep {kind}, state string")


#: Neighbouring nodes in a block, about.
BLOCK = 1 << 20


def gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches put together to `rows` rows, and less at the end; none is empty."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def _fallen(open_: DataFrame, bad: DataFrame) -> DataFrame:
    """`bad` (node) with all nodes of the edges `open_` that rest on them, over any number of edges."""
    while True:
        # what is known of the nodes that edges lead to: bad, good (without edges), or resting on one other only
        alone = open_.groupBy(F.col("node").alias("dep")).agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("to"))
        known = alone.select("dep", F.when(F.col("n") == 1, F.col("to")).alias("to"), F.lit("open").alias("state"))
        known = known.unionByName(bad.select(F.col("node").alias("dep"), F.lit(None).cast(dict(open_.dtypes)["dep"]).alias("to"), F.lit("bad").alias("state")))
        led = cut(open_.join(known, "dep", "left").select("node", F.coalesce("to", "dep").alias("dep"), F.coalesce("state", F.lit("good")).alias("state")))
        falls = cut(led.where("state = 'bad'").select("node").distinct())
        left = cut(led.where("state = 'open' AND node <> dep").select("node", "dep").distinct().join(falls, "node", "left_anti"))
        settled = open_.select("node").distinct().count() - left.select("node").distinct().count()
        bad, open_ = cut(bad.unionByName(falls)), left
        if not settled:
            return bad


def cycle_paths(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, path: walks from each start (node), in path order, up to the first node that they meet again."""
    walk = starts.select(F.col("node").alias("start"), F.array("node").alias("path"))
    out = None
    for _ in range(depth):
        step = walk.join(edges, F.element_at("path", -1) == edges.node).select("start", "path", F.col("dep").alias("next"))
        closed = step.where(F.array_contains("path", F.col("next"))).select("start", F.concat("path", F.array("next")).alias("path"))
        out = closed if out is None else out.unionByName(closed)
        walk = cut(step.where(~F.array_contains("path", F.col("next"))).select("start", F.concat("path", F.array("next")).alias("path")))
        if not walk.limit(1).count():
            break
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the strongly connected components of edges (node, dep) that hold a cycle; component is its smallest node.

    Nodes without an edge in or out are trimmed while that takes much away. Then chains are folded: a node with one edge in and one out is
    a link, links in a row are a path from one other node, a hub, to another, or a cycle by themselves, which is a component. Paths are
    found by doubling, so long cycles take few rounds. Hubs with an edge for each path go through rounds of colours (`_coloured`), and a
    path between two hubs of one component belongs to it.
    """
    left = cut(edges.select("node", "dep").where("node IS NOT NULL AND dep IS NOT NULL").distinct())
    loops = left.where("node = dep").select("node", F.col("node").alias("component"))
    left = trimmed(left.where("node <> dep"), 0.25)
    links = _links(left)
    paths = links.where("NOT open")
    # edges of hubs: to a hub, or over a path (its last link) to the hub behind it; `low` is the smallest link of a path
    over = paths.select(F.col("node").alias("dep"), "last", "low", "end")
    hubs = cut(left.join(links.select("node"), "node", "left_anti").join(over, "dep", "left").select("node", F.coalesce("end", "dep").alias("dep"), "last", "low"))
    held = cut(_coloured(hubs.select("node", "dep")))
    inside = hubs.where("last IS NOT NULL").join(held, "node").join(held.select(F.col("node").alias("dep"), F.col("component").alias("c")), "dep").where("component = c")
    inside = cut(inside.select("last", "low", "component"))
    lowest = inside.groupBy("component").agg(F.min("low").alias("low"))
    found = held.unionByName(paths.select("node", "last").join(inside.select("last", "component"), "last").select("node", "component"))
    found = found.join(lowest, "component", "left").select("node", F.least("component", "low").alias("component"))
    found = cut(found.unionByName(links.where("open").select("node", F.col("low").alias("component"))))
    return found.unionByName(loops.join(found, "node", "left_anti"))


def _links(edges: DataFrame) -> DataFrame:
    """node, last, low, end, open of the links of edges (node, dep): nodes with one edge in and one out.

    `last` is the last link of a path, `end` the node behind it, `low` the smallest link from a node to that one. Links that
    rest on themselves are `open`; there `low` is the smallest of the cycle.
    """
    ends = edges.select("node", "dep", F.lit(1).alias("out")).unionByName(edges.select(F.col("dep").alias("node"), F.lit(None).cast(dict(edges.dtypes)["dep"]).alias("dep"), F.lit(0).alias("out")))
    alone = cut(ends.groupBy("node").agg(F.min("dep").alias("dep"), F.sum("out").alias("n_out"), F.count(F.lit(1)).alias("n")).where("n_out = 1 AND n = 2").select("node", "dep"))
    here = alone.select(F.col("node").alias("dep"), F.lit(True).alias("open"))
    rows = alone.join(here, "dep", "left").select("node", F.coalesce("open", F.lit(False)).alias("open"), "dep")
    rows = cut(rows.select("node", F.when(F.col("open"), F.col("dep")).otherwise(F.col("node")).alias("last"), F.col("node").alias("low"), F.when(~F.col("open"), F.col("dep")).alias("end"), "open"))
    closed, rows = rows.where("NOT open"), rows.where("open")
    while True:
        # twice as far; a round in which no link comes to an end and none learns of a smaller one has been round all cycles
        ahead = closed.unionByName(rows).select(F.col("node").alias("last"), F.col("last").alias("to"), F.col("low").alias("other"), F.col("end").alias("behind"), F.col("open").alias("goes"))
        moved = Observation()
        led = rows.join(ahead, "last").select("node", F.col("to").alias("last"), F.least("low", "other").alias("low"), F.col("behind").alias("end"), F.col("goes").alias("open"), (F.col("other") < F.col("low")).alias("lower"))
        led = cut(led.observe(moved, F.count_if(F.col("lower") | ~F.col("open")).alias("n")))
        closed, rows = closed.unionByName(led.where("NOT open").drop("lower")), led.where("open").drop("lower")
        if not moved.get["n"]:
            return closed.unionByName(rows)


def _coloured(edges: DataFrame) -> DataFrame:
    """As `components`, by rounds of trimming and colours.

    Trimming takes away nodes without an edge in or out, again and again, which ends at once on
    most of a graph. Then every node takes the smallest node that reaches it as its colour, and those that reach
    the node of their own colour inside that colour are its component; they leave, and the rest goes on.
    """
    left, found = cut(edges.select("node", "dep").where("node IS NOT NULL AND dep IS NOT NULL").distinct()), None
    loops = cut(left.where("node = dep").select("node"))
    left = cut(left.where("node <> dep"))
    while True:
        left = trimmed(left)
        if not left.limit(1).count():
            break
        colour = _spread(left.select(F.col("node").alias("src"), F.col("dep").alias("dst")), left.select(F.col("node").alias("at")).distinct().select("at", F.col("at").alias("colour")))
        of = lambda c: colour.select(F.col("at").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = cut(left.join(of("node"), "node").join(of("dep"), "dep").where("node_colour = dep_colour").select("node", "dep", F.col("node_colour").alias("component")))
        reached = frontier = cut(same.select(F.col("component").alias("node"), "component").distinct())
        while True:  # backwards from each colour's own node, inside the colour
            step = same.join(frontier.select(F.col("node").alias("dep"), "component"), ["dep", "component"]).select("node", "component").distinct()
            frontier = cut(step.join(reached, ["node", "component"], "left_anti"))
            if not frontier.limit(1).count():
                break
            reached = cut(reached.unionByName(frontier))
        # a colour's node alone is no cycle
        held = cut(reached.join(reached.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component"), "component", "left_semi").select("node", "component"))
        found = held if found is None else found.unionByName(held)
        gone = reached.select("node")
        left = cut(left.join(gone, "node", "left_anti").join(gone.withColumnRenamed("node", "dep"), "dep", "left_anti").select("node", "dep"))
    alone = loops.select("node", F.col("node").alias("component"))
    return alone if found is None else found.unionByName(alone.join(found, "node", "left_anti"))


def trimmed(edges: DataFrame, least: float = 0) -> DataFrame:
    """`edges` (node, dep) without the nodes that no cycle can hold: those with no edge in, or none out, over and over, as long as
    more than the share `least` of the edges goes."""
    n = edges.count()
    while True:
        ends = edges.select(F.col("dep").alias("node"))
        fewer = edges.join(ends, "node", "left_semi").join(edges.select(F.col("node").alias("dep")), "dep", "left_semi").select("node", "dep")
        fewer = cut(fewer)
        left = fewer.count()
        if n - left <= n * least:
            return fewer
        edges, n = fewer, left


def _spread(edges: DataFrame, colour: DataFrame) -> DataFrame:
    """at, colour: the smallest colour that reaches each node over edges (src, dst); only what has changed moves on."""
    colour = moved = cut(colour)
    while True:
        sent = edges.join(moved, edges.src == moved.at).groupBy(F.col("dst").alias("goal")).agg(F.min("colour").alias("sent"))
        moved = cut(colour.join(sent, colour.at == sent.goal).where("sent < colour").select("at", F.col("sent").alias("colour")))
        if not moved.limit(1).count():
            return colour
        told = moved.select(F.col("at").alias("of"), F.col("colour").alias("told"))
        colour = cut(colour.join(told, colour.at == told.of, "left").select("at", F.coalesce("told", "colour").alias("colour")))


#: Nodes up to which a cycle is followed in one row.
RING = 64


def witnesses(edges: DataFrame, held: DataFrame) -> DataFrame:
    """component, path: one shortest cycle through each component's own node, from it back to it; the smallest of equal ones.

    A component whose nodes all have one edge in it is a single cycle, which is followed in one row up to RING nodes. In others, a search from
    that node inside its component, one level a round: a node is met once, with one path.
    """
    inside = edges.select("node", "dep").join(held, "node").join(held.select(F.col("node").alias("dep"), F.col("component").alias("c")), "dep").where("component = c").select("node", "dep", "component")
    inside = cut(inside.distinct())
    sizes = inside.groupBy("component", "node").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("n"))
    rings = cut(sizes.where((F.col("most") == 1) & (F.col("n") <= RING)).select("component", "n"))
    turns = inside.join(rings, "component").groupBy("component", "n").agg(F.map_from_entries(F.collect_list(F.struct("node", "dep"))).alias("next"))
    followed = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.array("component"), lambda path, _: F.concat(path, F.array(F.col("next")[F.element_at(path, -1)])))
    closed = cut(turns.select("component", followed.alias("path")))
    inside, held = (rows.join(rings, "component", "left_anti") for rows in (inside, held))
    walks = cut(held.where("node = component").select("component", "node", F.array("node").alias("path")))
    if not walks.limit(1).count():
        return closed
    inside, met = cut(inside), walks.select("component", "node")
    while True:
        step = walks.join(inside, ["component", "node"]).select("component", F.col("dep").alias("node"), F.concat("path", F.array("dep")).alias("path"))
        step = cut(step.groupBy("component", "node").agg(F.min("path").alias("path")))
        back = step.where("node = component").select("component", "path")
        closed = closed.unionByName(back.join(closed, "component", "left_anti"))
        closed = cut(closed)
        walks = cut(step.join(met, ["component", "node"], "left_anti").join(closed, "component", "left_anti"))
        if not walks.limit(1).count():
            return closed
        met = cut(met.unionByName(walks.select("component", "node")))


def difference(model: DataFrame, engine: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, model, engine of the rows in which two results differ, null-safe; a row missing on a side is null."""
    a, b = model.select(*keys, F.struct(value).alias("__a")), engine.select(*keys, F.struct(value).alias("__b"))
    both = a.join(b, keys, "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return both.select(*keys, F.col(f"__a.{value}").alias("model"), F.col(f"__b.{value}").alias("engine"))

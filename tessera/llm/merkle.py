"""Merkle manifest of a dataset: a digest tree for each source and one over the sources, with proofs for every row.

Leaves are digests of rows; H is the lowercase hex SHA-256 of its concatenated inputs. The tree of a group is built level by
level: a window by group and parent index, over its whole frame in order, collects a run of FAN nodes, which is the
parent's preimage and holds each node's siblings; one node of each run then stands for the parent in the next level. A
node alone in its group is the group's root. The roots of the groups, in the order of the sources, are the leaves of
the tree above.

A proof is a node's siblings, level by level. It is handed down from the root: each level is joined with the paths of its
parents, so a path grows by one step a level and only the last join has as many rows as the table. Texts are read
once and never shuffled; a level is written in the shared folder, which cuts its lineage. Levels come from the size of the
largest group, so the driver sees one number.

A leaf's place in its group comes from ranges by (source, doc_id) of bounded size, which split a hot source; no group
meets in one task at any level, as all windows and joins are by group and parent.

Defined cases: nulls enter a leaf as `-` and order first; an empty text has zero bytes; a text of any length is one row;
rows that share an id (ties) are ordered by their leaves, so repeated rows stand beside each other and each has a proof; a
null id is never tampered with; an empty table gives no rows; further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import shared_folder, written
from tessera.operators.numbering import ROWS

#: Nodes that a parent has at most.
FAN = 3
#: What a row's leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One step of a path: the siblings before and after a node, concatenated.
STEP = "array<struct<l:string,r:string>>"


def framed(value: Column) -> Column:
    """The UTF-8 length, `:` and the value; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """H of the framed columns."""
    return F.sha2(F.concat(*map(framed, columns)), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that `start` leads to along a path of siblings."""
    return F.aggregate(path, start, lambda digest, s: F.sha2(F.concat(s.l, digest, s.r), 256))


def proof(path: Column) -> Column:
    """H of all siblings of a path, from left to right in each level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.l, s.r)), ""), 256)


def indexed(rows: DataFrame, group: str, order: list[str], folder: str, name: str) -> DataFrame:
    """`rows` with `idx`, the place from 0 in the row's group by `order` (nulls first), and `n`, the size of the group.

    Ranges by (group, order) hold about ROWS rows each and are written first, as bounds sampled twice would differ. Only
    counts, one row for each range and group in it, meet by group.
    """
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS))
    dealt = rows.repartitionByRange(ranges, group, *order).sortWithinPartitions(group, *order)
    placed = written(dealt.withColumn("at", F.monotonically_increasing_id()), folder, f"{name}-ranged").withColumn("range", F.shiftright("at", 33))
    counts = placed.groupBy("range", group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first")
    starts = counts.select(F.col("range").alias("of_range"), F.col(group).alias("of_group"), shift.alias("shift"), F.sum("size").over(whole).alias("n"))
    joined = placed.join(starts, (F.col("range") == F.col("of_range")) & F.col(group).eqNullSafe(F.col("of_group")))
    return joined.withColumn("idx", F.col("at") + F.col("shift")).drop("at", "range", "of_range", "of_group", "shift")


def levels(leaves: DataFrame, group: str, folder: str, name: str) -> list[DataFrame]:
    """The levels of all groups' trees from `leaves` (group, idx, n, digest and more), which keep their columns.

    Each has group, idx, n (nodes of the group in this level), digest, own (the step with the node's siblings, empty where
    the node is alone) and up (the parent's digest, in the first row of each run). The last level has single nodes only.
    """
    nodes, made = leaves, []
    while True:
        run = Window.partitionBy(group, F.expr(f"idx div {FAN}")).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        at = F.col("idx") % FAN
        table = nodes.withColumn("kids", F.collect_list("digest").over(run))
        side = lambda test: F.array_join(F.filter("kids", test), "")
        table = table.withColumn("own", F.array(F.struct(side(lambda x, i: i < at).alias("l"), side(lambda x, i: i > at).alias("r"))))
        table = table.withColumn("own", F.when(F.col("n") > 1, F.col("own")).otherwise(F.array().cast(STEP)))
        table = table.withColumn("up", F.when((at == 0) & (F.col("n") > 1), F.sha2(F.array_join("kids", ""), 256))).drop("kids")
        made.append(written(table, folder, f"{name}-level-{len(made)}"))
        most = made[-1].agg(F.max("n")).first()[0] or 1
        if most == 1:
            return made
        nodes = made[-1].where("up IS NOT NULL").select(group, F.expr(f"idx div {FAN}").alias("idx"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("up").alias("digest"))


def roots(made: list[DataFrame], group: str) -> DataFrame:
    """group, subroot: the digest of the node that is alone in its group, one for each group."""
    found = None
    for level in made:
        alone = level.where("n = 1").select(group, F.col("digest").alias("subroot"))
        found = alone if found is None else found.unionByName(alone)
    return found


def paths(made: list[DataFrame], group: str, above: DataFrame, folder: str, name: str) -> DataFrame:
    """The leaves with `subroot` and `path`, all siblings up to the root of the group and on along `above` (of_group,
    subroot, path: one row for each group)."""
    found = None
    for k in reversed(range(len(made))):
        level = made[k]
        alone = level.where("n = 1").join(above, F.col(group).eqNullSafe(F.col("of_group"))).drop("of_group")
        rows = alone.drop("own", "up", "n")
        if found is not None:
            parents = found.select(F.col(group).alias("of_group"), F.col("idx").alias("of_idx"), "subroot", F.col("path").alias("rest"))
            more = level.where("n > 1").join(parents, F.col(group).eqNullSafe(F.col("of_group")) & (F.expr(f"idx div {FAN}") == F.col("of_idx")))
            more = more.withColumn("path", F.concat("own", "rest")).drop("of_group", "of_idx", "rest", "own", "up", "n")
            rows = rows.unionByName(more)
        found = written(rows, folder, f"{name}-paths-{k}") if k else rows
    return found


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = FIELDS, seen: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, path, subroot, root for every row, under these names whatever the columns are called.

    `seen` replaces fields by other columns: `seen_leaf` is then the leaf of the row as seen, null where all of `seen` is null.
    """
    folder = shared_folder(docs.sparkSession)
    other = leaf([(seen or {}).get(c, F.col(c)) for c in fields])
    known = F.coalesce(*(F.isnotnull(c) for c in (seen or {}).values()), F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group_col).alias("source"), leaf([F.col(c) for c in fields]).alias("digest"), F.when(known, other).alias("seen_leaf"))
    rows = written(rows, folder, "leaves")
    made = levels(indexed(rows, "source", ["doc_id", "digest"], folder, "rows"), "source", folder, "rows")
    tops = written(roots(made, "source"), folder, "subroots").select(F.lit(0).alias("all"), "source", F.col("subroot").alias("digest"))
    above = levels(indexed(tops, "all", ["source"], folder, "sources"), "all", folder, "sources")
    whole = roots(above, "all").select(F.lit(0).alias("of_group"), F.col("subroot"), F.array().cast(STEP).alias("path"))
    over = paths(above, "all", whole, folder, "sources").select(F.col("source").alias("of_group"), F.col("digest").alias("subroot"), "path")
    root = whole.first()
    found = paths(made, "source", written(over, folder, "above"), folder, "rows")
    return found.select("doc_id", "source", F.col("digest").alias("leaf"), "path", "subroot", F.lit(root.subroot if root else None).cast("string").alias("root"), "seen_leaf")


def verify(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, verified for every row of `docs`: whether it is a row of the manifest `known`, by its leaf and its path.

    Rows meet their paths by id and leaf; a row whose leaf the manifest lacks is not verified.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), leaf([F.col(c) for c in fields]).alias("seen"))
    held = known.where(fold(F.col("leaf"), F.col("path")) == F.col("root")).select(F.col("doc_id").alias("of_id"), F.col("leaf").alias("of_leaf")).distinct()
    found = rows.join(held, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("seen") == F.col("of_leaf")), "left")
    return found.select("doc_id", F.col("of_leaf").isNotNull().alias("verified"))


def op12_merkle(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`; every second row by crc32 is seen without its line feeds."""
    from tessera.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    cut = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = manifest(docs, seen={"text": F.when(cut, F.translate("text", "\n", ""))})
    folded = fold(F.coalesce("seen_leaf", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """Each level by a CTE, more of them than 3 to the power of the largest table; a node alone in its group stays."""
    frame = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(frame(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    step = "(CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d : ascii(d)::BIGINT)), lambda acc, b : list_reduce(list_prepend(xor(acc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i : {step}))"
    rows = f"""rows AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, {leaf_of("text")} AS leaf,
  CASE WHEN (xor({crc}, 4294967295) & 1) = 0 THEN {leaf_of("replace(text, chr(10), '')")} ELSE {leaf_of("text")} END AS seen FROM documents)"""

    def tree(name: str, first: str, deep: int) -> str:
        parts = [f"{name}0 AS MATERIALIZED ({first})"]
        for k in range(1, deep + 1):
            parts.append(f"""{name}{k} AS MATERIALIZED (SELECT g, idx // 3 AS idx, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest,
  (max(n) + 2) // 3 AS n FROM {name}{k - 1} GROUP BY g, idx // 3)""")
        every = " UNION ALL ".join(f"SELECT {k} AS level, g, idx, digest, n FROM {name}{k}" for k in range(deep))
        parts.append(f"""{name}s AS MATERIALIZED (SELECT level, g, idx, n > 1 AS run,
  coalesce(string_agg(digest, '') OVER (PARTITION BY level, g, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(digest, '') OVER (PARTITION BY level, g, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM ({every}))""")
        return ", ".join(parts)

    deep, high = 14, 8
    return f"""WITH RECURSIVE {rows},
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM rows),
{tree("d", "SELECT source AS g, idx, leaf AS digest, n FROM placed", deep)},
tops AS MATERIALIZED (SELECT g AS source, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n, digest FROM d{deep}),
{tree("t", "SELECT 'all' AS g, idx, digest, n FROM tops", high)},
steps AS MATERIALIZED (SELECT * FROM ds UNION ALL SELECT level + {deep}, g, idx, run, l, r FROM ts),
walk AS (SELECT rid, 0 AS at, source AS g, idx, '' AS path, seen AS digest FROM placed
  UNION ALL SELECT w.rid, w.at + 1, CASE WHEN w.at + 1 = {deep} THEN 'all' ELSE w.g END, CASE WHEN w.at + 1 = {deep} THEN t.idx ELSE w.idx // 3 END, w.path || s.l || s.r,
    CASE WHEN s.run THEN sha256(s.l || w.digest || s.r) ELSE w.digest END
  FROM walk w JOIN steps s ON w.at = s.level AND w.g IS NOT DISTINCT FROM s.g AND w.idx = s.idx LEFT JOIN tops t ON w.at + 1 = {deep} AND t.source IS NOT DISTINCT FROM w.g)
SELECT p.doc_id, p.leaf, t.digest AS subroot, top.digest AS root, sha256(w.path) AS proof_sha256, w.digest AS folded_root, w.digest = top.digest AS verified
FROM placed p JOIN walk w ON w.rid = p.rid AND w.at = {deep + high} JOIN tops t ON t.source IS NOT DISTINCT FROM p.source JOIN t{high} top ON top.g = 'all'"""


ORACLE_SQL = _sql()

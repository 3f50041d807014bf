"""Sharding by extendible hashing (DataFrame functions only).

A row's key hashes to a bit string. The directory starts as one bucket; a bucket over the byte limit is split on
one more bit of the hash, and only such buckets are, so local depths differ and every shard fits the limit.

The directory is found from byte counts, not by moving rows: rows are summed into cells of a fixed number of
prefix bits (with map-side combining), every cell adds to each of its ancestors, and the shards are the
shallowest nodes that fit, that is, those that fit while their parent does not. Where single cells do not fit,
only these are counted again with more bits.

A key that alone is over the limit cannot be split on its hash. Such a bucket of full depth gets overflow pages,
as in extendible hashing on disk: its rows are dealt out by a second hash of the row's content and, for rows
equal in all, by a number that was written with the row, into as many pages as the limit asks for.

Defined cases: a null text has 0 bytes; an empty table has no shards; a very long text, a single row over the limit, is a
page of its own size that no split can shrink, and is marked by oversize; keys that hash alike (ties) share a shard or
its pages; repeated rows each count; a null key hashes like the empty string; further columns are ignored, and when
shards are written they are kept, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, fresh, shared_folder, written

#: Bits of the hash in use: 60 of an MD5, which every SQL engine has.
BITS = 60
#: Bits that a round of counting adds.
STEP = 10
#: Cells up to which the directory is broadcast (about 100 bytes each).
BROADCAST_CELLS = 200_000


def hash_bits(key) -> F.Column:
    """The first 60 bits of the MD5 of a key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def _prefix(column: str, depth) -> str:
    return f"shiftright({column}, {BITS} - CAST({depth} AS INT))"


def directory(sizes: DataFrame, limit: int, folder: str, step: int = STEP) -> DataFrame:
    """cell_depth, cell, depth, prefix, shard_bytes, shard_rows: the shard of each cell of rows (bits, bytes)."""
    found, live, upto = None, sizes, 0
    while upto < BITS:
        low, upto = upto, min(BITS, upto + step)
        cells = live.groupBy(F.expr(_prefix("bits", upto)).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
        cells = written(cells, folder, f"cells-{upto}")
        # every cell adds to its ancestors of this round; the depth above them is over the limit, or the root
        nodes = cells.select(F.explode(F.expr(f"sequence({low}, {upto})")).alias("depth"), "cell", "bytes", "rows")
        nodes = nodes.groupBy("depth", F.expr(f"shiftright(cell, {upto} - depth)").alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
        nodes = written(nodes, folder, f"nodes-{upto}")
        fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("depth") == BITS))
        tree = cells.select("cell", F.explode(F.expr(f"sequence({low}, {upto})")).alias("depth")).withColumn("prefix", F.expr(f"shiftright(cell, {upto} - depth)"))
        shards = tree.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("s"))
        shards = written(shards.select(F.lit(upto).alias("cell_depth"), "cell", "s.*"), folder, f"shards-{upto}")
        found = shards if found is None else found.unionByName(shards)
        open_cells = written(cells.join(shards.select("cell"), "cell", "left_anti").select("cell"), folder, f"open-{upto}")
        if not open_cells.limit(1).count():
            return found
        live = live.join(open_cells.withColumnRenamed("cell", "__open"), F.expr(f"{_prefix('bits', upto)} = __open"), "left_semi")
    return found


def assign_shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int = STEP) -> DataFrame:
    """One row per row of `docs`: doc_id, bytes, depth, prefix, page, shard, shard_bytes, shard_rows, oversize."""
    if limit < 1:
        raise ValueError("the byte limit is at least 1")
    folder = shared_folder(docs.sparkSession)
    text = doc_text(text_col)
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), hash_bits(F.col(id_col)).alias("bits"), F.xxhash64(text).alias("content"))
    sizes = written(sizes.withColumn("row", F.monotonically_increasing_id()), folder, "sizes")
    shards = directory(sizes, limit, folder, step)
    few = shards.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    depths = [r.cell_depth for r in shards.select("cell_depth").distinct().collect()]  # at most BITS / step numbers
    out = None
    for d in depths:
        mine = shards.where(F.col("cell_depth") == d).drop("cell_depth")
        rows = sizes.withColumn("cell", F.expr(_prefix("bits", d))).join(F.broadcast(mine) if few else mine, "cell").drop("cell")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = sizes.withColumns({"depth": F.lit(0), "prefix": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long"), "shard_rows": F.lit(0).cast("long")}).limit(0)
    return _paged(out, limit, folder)


def _paged(rows: DataFrame, limit: int, folder: str) -> DataFrame:
    """Deals the buckets that no bit splits into overflow pages of at most `limit` bytes, but for longer rows."""
    over = written(rows.where(F.col("shard_bytes") > limit), folder, "over")
    fine = rows.where(F.col("shard_bytes") <= limit).withColumn("page", F.lit(0).cast("long"))
    if over.limit(1).count():
        # parts of about a page by content and, for equal rows, by the number written with each row, so that a page's
        # name is the same in every run of the plan; each part is small, and running sums inside a part place its rows
        parts = F.expr("pmod(xxhash64(content, doc_id, row), greatest(1L, shard_bytes div {0}))".format(limit))
        over = written(over.withColumn("part", parts), folder, "parts")
        big = F.col("bytes") > max(1, limit // 2)  # each on a page of its own
        inside = Window.partitionBy("depth", "prefix", "part", "big").orderBy("content", "doc_id", "row")
        run = over.withColumn("big", big).withColumn("__upto", F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__nth", F.row_number().over(inside))
        over = run.withColumn("page", F.expr(f"part * 2147483648L + IF(big, 1073741824L + __nth, greatest(0L, (__upto - 1) div {max(1, limit // 2)}))"))
        pages = over.groupBy("depth", "prefix", "page").agg(F.sum("bytes").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
        over = over.join(pages, ["depth", "prefix", "page"]).withColumns({"shard_bytes": F.col("__bytes"), "shard_rows": F.col("__rows")}).select(*fine.columns)
        fine = fine.unionByName(over)
    shard = F.concat(F.lpad(F.col("depth").cast("string"), 2, "0"), F.lit("-"), F.lower(F.hex("prefix")), F.when(F.col("page") > 0, F.concat(F.lit("-"), F.col("page").cast("string"))).otherwise(F.lit("")))
    return fine.select("doc_id", "bytes", "depth", "prefix", "page", shard.alias("shard"), "shard_bytes", "shard_rows", (F.col("shard_bytes") > limit).alias("oversize"))


#: Shards that a task writes, about.
SHARDS_A_TASK = 16


def write_shards(docs: DataFrame, assigned: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """Writes `docs`, whose ids are unique, as one directory per shard under `folder`.

    The number of tasks follows the number of shards, and rows are sorted by shard, so a task has one file open.
    """
    name = "shard" if "shard" not in [c.lower() for c in docs.columns] else fresh("shard")
    number = fresh("id")
    tasks = math.ceil(assigned.select("shard").distinct().count() / SHARDS_A_TASK) or 1
    placed = docs.join(assigned.select(F.col("doc_id").alias(number), F.col("shard").alias(name)), F.col(id_col) == F.col(number)).drop(number)
    placed.repartition(tasks, name).sortWithinPartitions(name).write.partitionBy(name).option("compression", "zstd").parquet(folder)


#: Bytes of text that a shard of the query may have at most, and shards that a smaller table is still dealt into, about.
LIMIT, SHARDS = 32 << 20, 32


def shard_limit(docs: DataFrame, text_col: str = "text", most: int = LIMIT, shards: int = SHARDS) -> int:
    """The byte limit for a table: `most`, or what makes about `shards` shards of a table that has less and holds its
    longest text."""
    size = F.octet_length(doc_text(text_col)).cast("long")
    found = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total"), F.coalesce(F.max(size), F.lit(0)).alias("longest")).first()
    return max(1, min(most, max(found.total // shards, found.longest)))


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every row of `documents`, keyed by doc_id."""
    from tessera.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    return assign_shards(docs, shard_limit(docs))


#: Every depth of the directory. Texts of over LIMIT bytes, which get pages, are not in it; the given tables have none.
ORACLE_SQL = f"""
WITH sizes AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS bits
  FROM documents
), lim AS (
  SELECT greatest(1, least({LIMIT}, greatest(sum(bytes) // {SHARDS}, max(bytes)))) AS most FROM sizes
), nodes AS (
  SELECT d.depth, bits >> (60 - d.depth) AS prefix, sum(bytes) AS shard_bytes, count(*) AS shard_rows
  FROM sizes, (SELECT unnest(range(0, 61)) AS depth) d GROUP BY ALL
), placed AS (
  SELECT s.doc_id, s.bytes, n.depth, n.prefix, n.shard_bytes, n.shard_rows,
         row_number() OVER (PARTITION BY s.doc_id ORDER BY n.depth) AS r
  FROM sizes s JOIN nodes n ON n.prefix = s.bits >> (60 - n.depth), lim WHERE n.shard_bytes <= lim.most
)
SELECT doc_id, bytes, CAST(depth AS INTEGER) AS depth, prefix, CAST(0 AS BIGINT) AS page,
       lpad(CAST(depth AS VARCHAR), 2, '0') || '-' || lower(printf('%x', prefix)) AS shard,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows, false AS oversize
FROM placed WHERE r = 1
"""

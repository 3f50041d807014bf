"""Global numbering, and looks at the row before, without a global sort or a whole key's history in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.lineage import cut

#: Rows in a range, about; the number of ranges follows the number of rows.
ROWS = 1_000_000
#: Orders (versions, commits) in a block of a key's history.
BLOCK = 1 << 20


def _ranged(rows: DataFrame, by: Column, then: list[str], ranges: int | None) -> DataFrame:
    """`rows`, sorted, with __range and __index: ranges by (`by`, `then`) and places from 0 inside them.

    The ranges are Spark's, by sampled bounds; `then` splits equal values of `by`. They are written before anything is
    made of them, as bounds sampled a second time would be others.
    """
    if ranges is None:
        ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / ROWS))
    keyed = rows.withColumn("__tessera_by", by).repartitionByRange(ranges, "__tessera_by", *then).sortWithinPartitions("__tessera_by", *then)
    # the number has the partition above bit 33 and the place in it below
    placed = cut(keyed.drop("__tessera_by").withColumn("__tessera_at", F.monotonically_increasing_id()))
    return placed.withColumns({"__tessera_range": F.shiftright("__tessera_at", 33), "__tessera_index": F.col("__tessera_at").bitwiseAND((1 << 33) - 1)}).drop("__tessera_at")


def _before(ranged: DataFrame, size: Column) -> DataFrame:
    """__range, __before: the sum of the sizes of the ranges before; one row for each range meets in one place."""
    before = Window.orderBy("__tessera_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("__tessera_range").agg(size.alias("__tessera_size"))
    return sizes.select("__tessera_range", F.coalesce(F.sum("__tessera_size").over(before), F.lit(0)).alias("__tessera_before"))


def numbered(rows: DataFrame, number: str, by: Column, then: list[str], ranges: int | None = None) -> DataFrame:
    """`rows` with the 1-based rank by (`by`, a long, then the columns `then`) in `number`.

    A row's number is the size of the ranges before its own plus its place inside it, so each task sorts one range
    of about ROWS rows, and the ranges' sizes, a row for each, are all that is broadcast.
    """
    ranged = _ranged(rows, by, then, ranges)
    placed = ranged.join(F.broadcast(_before(ranged, F.count(F.lit(1)))), "__tessera_range")
    return placed.withColumn(number, (F.col("__tessera_before") + F.col("__tessera_index") + 1).cast("long")).drop("__tessera_range", "__tessera_index", "__tessera_before")


def running_sum(rows: DataFrame, out: str, value: str, by: str, ranges: int | None = None) -> DataFrame:
    """`rows` with the sum of `value` over all rows up to each by the unique long `by`, without one global window."""
    ranged = _ranged(rows, F.col(by), [], ranges)
    inside = Window.partitionBy("__tessera_range").orderBy("__tessera_index").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("__tessera_run", F.sum(value).over(inside)).join(F.broadcast(_before(ranged, F.sum(value))), "__tessera_range")
    return run.withColumn(out, (F.col("__tessera_before") + F.col("__tessera_run")).cast("long")).drop("__tessera_range", "__tessera_index", "__tessera_run", "__tessera_before")


def running_count(rows: DataFrame, out: str, value: Column, order: list[str], ranges: int | None = None) -> DataFrame:
    """`rows` with the sum of `value` over all rows before each in the order of the columns `order`; among equals, any order.

    As in `running_sum`, a task sums one range and only the ranges' sums meet.
    """
    ranged = _ranged(rows.withColumn("__tessera_value", value), F.lit(0), order, ranges)
    inside = Window.partitionBy("__tessera_range").orderBy("__tessera_index").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("__tessera_run", F.coalesce(F.sum("__tessera_value").over(inside), F.lit(0)))
    run = run.join(F.broadcast(_before(ranged, F.sum("__tessera_value"))), "__tessera_range")
    return run.withColumn(out, (F.col("__tessera_before") + F.col("__tessera_run")).cast("long")).drop("__tessera_range", "__tessera_index", "__tessera_run", "__tessera_before", "__tessera_value")


def _carried(rows: DataFrame, out: str, key: str, order: str, inside: Column, end: Column, over: Column, join: Column) -> DataFrame:
    """`rows` with `out`: `inside` its block of a key's history, or, where `join` says so, what other blocks hand on.
    `end` sums a block up, `over` looks at the blocks, of which a key has one for each BLOCK orders."""
    blocked = rows.withColumn("__tessera_block", F.floor(F.col(order) / BLOCK).cast("long")).withColumn(out, inside)
    ends = blocked.groupBy(F.col(key).alias("__tessera_key"), F.col("__tessera_block").alias("__tessera_of")).agg(end.alias("__tessera_end"))
    handed = ends.select("__tessera_key", "__tessera_of", over.alias("__tessera_carry"))
    both = blocked.join(handed, F.col(key).eqNullSafe(F.col("__tessera_key")) & (F.col("__tessera_block") == F.col("__tessera_of")))
    return both.withColumn(out, join).drop("__tessera_block", "__tessera_key", "__tessera_of", "__tessera_carry")


def previous(rows: DataFrame, out: str, key: str, order: str, what: Column) -> DataFrame:
    """`rows` with the struct `what` of the key's row before by the unique long `order`; null for its first."""
    inside, blocks = Window.partitionBy(key, "__tessera_block").orderBy(order), Window.partitionBy("__tessera_key").orderBy("__tessera_of")
    return _carried(rows, out, key, order, F.lag(what).over(inside), F.max_by(what, order), F.lag("__tessera_end").over(blocks), F.coalesce(out, "__tessera_carry"))


def following(rows: DataFrame, out: str, key: str, order: str, what: Column) -> DataFrame:
    """`rows` with the struct `what` of the key's row after by the unique long `order`; null for its last."""
    inside, blocks = Window.partitionBy(key, "__tessera_block").orderBy(order), Window.partitionBy("__tessera_key").orderBy("__tessera_of")
    return _carried(rows, out, key, order, F.lead(what).over(inside), F.min_by(what, order), F.lead("__tessera_end").over(blocks), F.coalesce(out, "__tessera_carry"))


def last_known(rows: DataFrame, out: str, key: str, order: str, what: Column) -> DataFrame:
    """`rows` with the last non-null `what` of the key up to each row by the unique long `order`."""
    inside = Window.partitionBy(key, "__tessera_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy("__tessera_key").orderBy("__tessera_of").rowsBetween(Window.unboundedPreceding, -1)
    end = F.max_by(what, F.when(what.isNotNull(), F.col(order)))
    return _carried(rows, out, key, order, F.last(what, ignorenulls=True).over(inside), end, F.last("__tessera_end", ignorenulls=True).over(blocks), F.coalesce(out, "__tessera_carry"))


def largest_before(rows: DataFrame, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """`rows` with, for each of `values`, the largest one of the key's rows before by the unique long `order`; null for none.

    As above, in blocks; all values take one pass.
    """
    inside = Window.partitionBy(key, "__tessera_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = Window.partitionBy("__tessera_key").orderBy("__tessera_of").rowsBetween(Window.unboundedPreceding, -1)
    blocked = rows.withColumn("__tessera_block", F.floor(F.col(order) / BLOCK).cast("long")).withColumns({f"__tessera_v{i}": v for i, v in enumerate(values.values())})
    ends = blocked.groupBy(F.col(key).alias("__tessera_key"), F.col("__tessera_block").alias("__tessera_of")).agg(*(F.max(f"__tessera_v{i}").alias(f"__tessera_e{i}") for i in range(len(values))))
    handed = ends.select("__tessera_key", "__tessera_of", *(F.max(f"__tessera_e{i}").over(blocks).alias(f"__tessera_c{i}") for i in range(len(values))))
    here = blocked.withColumns({f"__tessera_i{i}": F.max(f"__tessera_v{i}").over(inside) for i in range(len(values))})
    both = here.join(handed, F.col(key).eqNullSafe(F.col("__tessera_key")) & (F.col("__tessera_block") == F.col("__tessera_of")))
    return both.select(*rows.columns, *(F.greatest(f"__tessera_i{i}", f"__tessera_c{i}").alias(name) for i, name in enumerate(values)))

"""What the corpus operators share: shared-folder tables, id and text columns, skew-safe lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lineage import shared_root

#: A key with more than 1/HOT_SHARE of the rows is hot; by counting there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: Ids (16 bytes each with overhead) up to which a list of dropped documents is broadcast.
BROADCAST_IDS = 200_000


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker is sent at once, in rows and in bytes, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: Working folders made in this process, for `release`.
_MADE: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, see `shared_root`."""
    _MADE.append(f"{shared_root(spark)}/tessera-{uuid.uuid4().hex}")
    return _MADE[-1]


def folders_made() -> int:
    """A mark for `release`."""
    return len(_MADE)


def release(spark: SparkSession, mark: int, keep: str | None = None) -> None:
    """Deletes the working folders made since `mark` but for `keep`; no plan may still read them."""
    for folder in _MADE[mark:]:
        if folder != keep:
            remove(spark, folder)
    _MADE[mark:] = [f for f in _MADE[mark:] if f == keep]


def fresh(name: str) -> str:
    """A column name that no table of a user has."""
    return f"__{name}_{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str, name: str, **options: str) -> DataFrame:
    """`df` written as Parquet under the shared folder and read again, which cuts its lineage."""
    path = f"{folder}/{name}"
    df.write.options(compression="zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this package wrote and that no later plan reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def doc_text(text_col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """`text` with A-Z, and nothing else, in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of `rows` with `facts`, which has one row per key and, in `weight`, the key's number of rows.

    Keys with over 1/HOT_SHARE of all rows are fewer than HOT_SHARE, so their facts are broadcast and
    their rows stay where they are; the rest, where no key is hot, is shuffled on the key.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    limit = max(total // HOT_SHARE, 1000)
    hot = F.broadcast(facts.where(F.col(weight) > limit))
    near = rows.join(hot, key)
    far = rows.join(hot.select(key), key, "left_anti").join(facts.where(F.col(weight) <= limit), key)
    return near.unionByName(far)


def without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """`docs` less the rows whose `keys` (compared null-safe) are in `dropped`.

    The dropped keys are broadcast while they are at most BROADCAST_IDS, else both sides are shuffled.
    """
    few = dropped.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    names = [fresh("dropped") for _ in keys]
    named = dropped.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return docs.join(F.broadcast(named) if few else named, on, "left_anti")


def apply_decisions(docs: DataFrame, decided: DataFrame, mark: Column, once_by_mark: bool, id_col: str = "doc_id") -> DataFrame:
    """`docs` less what was decided against: `decided` has doc_id, mark and kept for every row.

    Documents are dropped by id, so no text is shuffled while the dropped ids can be broadcast. Only rows
    whose id comes more than once are told apart by `mark`, an expression over `docs`; of those kept, one row for
    each id stays, or one for each id and mark. Helper columns have names that no table has.
    """
    folder = shared_folder(docs.sparkSession)
    columns, the_id, the_mark, is_kept, n = docs.columns, fresh("id"), fresh("mark"), fresh("kept"), fresh("n")
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    again = written(docs.groupBy(F.col(id_col).alias(the_id)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(the_id), folder, "again")
    gone = written(decided.where(~F.col("kept")).select(F.col("doc_id").alias(the_id)).unionByName(again).withColumnRenamed(the_id, id_col), folder, "gone")
    left = without(docs, gone, [id_col])
    if again.limit(1).count():
        more = docs.join(again, F.col(id_col).eqNullSafe(F.col(the_id)), "left_semi").withColumn(the_mark, mark)
        kept = decided.where("kept").select(F.col("doc_id").alias(the_id), F.col("mark").alias(is_kept)).distinct()
        more = more.join(kept, F.col(id_col).eqNullSafe(F.col(the_id)) & F.col(the_mark).eqNullSafe(F.col(is_kept)), "left_semi")
        left = left.unionByName(more.dropDuplicates([id_col, the_mark] if once_by_mark else [id_col]).select(columns))
    return left

"""Versioned key/value tables: snapshot reads, overlays, conflicts, recovery and compaction of a log.

A log has the columns key, version (a long that grows by one with each commit), value (nullable) and is_delete; a
newer row hides the older ones of its key, and a delete hides the key. Snapshots are versions: a read at version s
sees rows with version <= s only, which is also what prunes the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import cut
from tessera.operators.numbering import following, largest_before, last_known, previous

#: Commits in a block of a key's history.
COMMITS = 1024
#: Limits of a key's and of a value's size in bytes.
MAX_KEY, MAX_VALUE = 4096, 1 << 20


def invalid_entries(rows: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Rows with a reason for which a write of them is refused: empty_key, long_key or long_value."""
    size, long = F.octet_length(F.col(key)), F.octet_length(F.col(value)) > MAX_VALUE
    reason = F.when(size.isNull() | (size < 1), "empty_key").when(size > MAX_KEY, "long_key").when(long, "long_value")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL")


def state_at(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    """key, version, value, is_delete of the newest row of each key, as of a snapshot; deletes included.

    One aggregation with a map-side combine, so a key with many versions does not meet in one task.
    """
    seen = log if snapshot is None else log.where(F.col("version") <= snapshot)
    newest = seen.groupBy("key").agg(F.max_by(F.struct("version", "value", "is_delete"), "version").alias("n"))
    return newest.select("key", "n.version", "n.value", "n.is_delete")


def latest(log: DataFrame, snapshot: int | Column | None = None) -> DataFrame:
    """key, version, value of the keys that live at a snapshot."""
    return state_at(log, snapshot).where(~F.col("is_delete")).drop("is_delete")


def get_many(log: DataFrame, keys: list, snapshot: int | None = None) -> DataFrame:
    """key, value for the asked keys; null where a key does not live. The keys are pushed to the scan."""
    asked = log.sparkSession.createDataFrame([(k,) for k in keys], log.select("key").schema)
    found = latest(log.where(F.col("key").isin(keys)), snapshot)
    return asked.join(F.broadcast(found), "key", "left").select("key", "value")


def prefix_scan(table: DataFrame, key: str, prefix) -> DataFrame:
    """Rows whose key starts with a prefix, in the order of the keys."""
    return table.where(F.startswith(F.col(key), F.lit(prefix))).orderBy(key)


def overlay(base: DataFrame, writes: DataFrame) -> DataFrame:
    """key, value as a transaction sees it: its own writes (key, value, is_delete) over a snapshot (key, value)."""
    w = writes.select("key", F.col("value").alias("__own"), "is_delete")
    both = base.select("key", "value").join(w, "key", "full_outer")
    own = F.col("is_delete").isNotNull()
    return both.where(~own | ~F.col("is_delete")).select("key", F.when(own, F.col("__own")).otherwise(F.col("value")).alias("value"))


def conflicts_pairwise(writes: DataFrame) -> DataFrame:
    """txn, other, key of writes (txn, key, begin, commit) whose key another transaction wrote and committed between.

    This compares pairs as they are; a transaction that lost still counts here (see commit_fold for the outcome). The
    join is on the key and a block of COMMITS commits, and a write asks only for the blocks that its lifetime meets, so
    neither the history of a hot key nor its pairs meet in one task.
    """
    other = writes.select("key", F.col("txn").alias("other"), F.col("commit").alias("__committed"), F.floor(F.col("commit") / COMMITS).alias("__block"))
    blocks = F.sequence(F.floor((F.col("begin") + 1) / COMMITS), F.floor((F.col("commit") - 1) / COMMITS))
    asks = writes.where("commit - begin > 1").withColumn("__block", F.explode(blocks))
    late = (F.col("__committed") > F.col("begin")) & (F.col("__committed") < F.col("commit"))
    return asks.join(other, ["key", "__block"]).where(late & (F.col("other") != F.col("txn"))).select("txn", "other", "key").distinct()


def commit_fold(writes: DataFrame, group: str, known: str | None = None) -> DataFrame:
    """group, txn, committed: first committer wins, in the order of the commits.

    `writes` has group, txn, key, begin, commit; groups share no key. Of a group, transactions are taken by their
    commit; one fails if a key of it was written by a transaction that succeeded after its begin. What failed wrote
    nothing, so it fails nobody else, which is why this fold is sequential inside a group (`commit_rounds` is not). A column
    `known` may say of transactions that they are committed; they are taken as such and not returned.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = txn = None  # the group and the transaction at hand; rows come in their order
        last: dict = {}
        keys: list = []
        ok, sure, commit, out = True, False, -1, []

        def end() -> None:
            if txn is not None:
                if not sure:
                    out.append((at, txn, ok))
                if ok:
                    last.update(dict.fromkeys(keys, commit))

        for pdf in batches:
            for g, c, t, k, b, s in zip(*(pdf[x].tolist() for x in (group, "commit", "txn", "key", "begin", "__known")), strict=True):
                if (g, t) != (at, txn):
                    end()
                    if g != at:
                        last = {}
                    at, txn, commit, ok, keys, sure = g, t, c, True, [], s
                keys.append(k)
                ok = sure or ok and last.get(k, -1) <= b
            yield pd.DataFrame(out, columns=[group, "txn", "committed"])
            out = []
        end()
        yield pd.DataFrame(out, columns=[group, "txn", "committed"])

    # many groups share a task, and only one group's keys are held at a time
    known = F.coalesce(F.col(known), F.lit(False)) if known else F.lit(False)
    ordered = writes.select(group, "commit", "txn", "key", "begin", known.alias("__known")).repartition(group).sortWithinPartitions(group, "commit", "txn", "key")
    return ordered.mapInPandas(fold, f"{group} long, txn long, committed boolean")


#: Rounds in which chains of transactions are decided together, before what is left of them is folded.
ROUNDS = 12
#: Histories that may be broadcast.
FEW = 100_000


def commit_rounds(writes: DataFrame, group: str, rounds: int = ROUNDS) -> DataFrame:
    """group, txn, committed as of `commit_fold`, for groups of any size.

    A rival of a transaction is one that commits between its begin and its commit and writes a key of it. In each round,
    a transaction fails that has a rival known to be committed, and one commits whose rivals have all failed; so
    round n decides all that is n rivals deep, of all groups at once. No pairs are made: for every write the last
    committed and the last undecided write of its key tell whether there is such a rival, and a key's history is looked at in
    blocks. Failed transactions leave the table, and committed ones after the round in which they could fail others, so rounds after the
    first cost what is still open and the keys that it waits on. What is still open after `rounds` rounds, long chains of transactions each of
    which waits for the one before, is folded in order with what is known.
    """
    open_ = F.col("__state").isNull()
    rows = writes.select(group, "txn", "key", "begin", "commit").distinct().withColumn("__history", F.struct(group, "key"))
    rows = cut(rows.withColumn("__state", F.lit(None).cast("boolean")))
    decided = None
    for _ in range(rounds):
        # commits grow along a history, so the last ones are the largest ones
        seen = largest_before(rows, "__history", "commit", {"__won": F.when(F.col("__state"), F.col("commit")), "__waits": F.when(open_, F.col("commit"))})
        late = lambda c: F.max(F.coalesce(F.col(c) > F.col("begin"), F.lit(False)))
        asked = seen.where(open_).groupBy(group, "txn").agg(late("__won").alias("fails"), late("__waits").alias("waits"))
        new = cut(asked.where("fails OR NOT waits").select(group, "txn", (~F.col("fails")).alias("committed")))
        if not new.limit(1).count():
            break
        decided = new if decided is None else decided.unionByName(new)
        told = new.withColumnRenamed("committed", "__told")
        moved = cut(rows.where(open_).join(told, [group, "txn"], "left").where("coalesce(__told, true)").withColumn("__state", F.col("__told")).drop("__told"))
        # what was committed before has failed all that it could; what is so now counts where others wait on its key
        waiting = cut(moved.where(open_).select("__history").distinct())
        n = waiting.count()
        if not n:
            return decided
        won = moved.where("__state").join(F.broadcast(waiting) if n <= FEW else waiting, "__history", "left_semi")
        rows = cut(moved.where(open_).unionByName(won.select(*moved.columns)))
    if decided is None:
        return rows.select(group, "txn", F.lit(True).alias("committed")).limit(0)
    left = rows.where(open_).select(group).distinct()
    if not left.limit(1).count():
        return decided
    return decided.unionByName(commit_fold(rows.join(left, group, "left_semi"), group, "__state").select(*decided.columns))


def horizon(checkpoint: int, active: list[int]) -> int:
    """The version up to which history may be pruned: no open snapshot may lose what it sees."""
    return min([checkpoint, *active])


def prune(log: DataFrame, upto: int) -> DataFrame:
    """The log without versions that no snapshot at or above `upto` can see: of each key the newest row at or
    below it and all above stay, and a delete that would be left alone goes."""
    rows = following(log, "__next", "key", "version", F.struct("version"))
    after = F.col("__next.version")
    stays = after.isNull() | (after > upto)
    alone = after.isNull() & F.col("is_delete") & (F.col("version") <= upto)  # nothing above it, and it hides what is below
    return rows.where(stays & ~alone).drop("__next")


def asof_join(asked: DataFrame, log: DataFrame, at: str = "at") -> DataFrame:
    """The rows of `asked` (key, a long column `at`, and more) with found_version and value: what each one's key has as
    of its own version; null where the key does not live then.

    Questions are put in line with the log's rows of their key, each after the version it asks for, and take the
    last row before them; histories are taken in blocks, so a hot key does not meet in one task. A question whose
    key is null finds nothing.
    """
    told = log.select("key", (2 * F.col("version")).alias("__order"), F.struct("version", "value", "is_delete").alias("__row"), F.lit(None).cast(asked.schema).alias("__asked"))
    what = F.struct(*(F.col(c) for c in asked.columns))
    line = told.unionByName(asked.select("key", (2 * F.col(at) + 1).alias("__order"), F.lit(None).cast(told.schema["__row"].dataType).alias("__row"), what.alias("__asked")))
    found = last_known(line, "__found", "key", "__order", F.col("__row")).where("__asked IS NOT NULL")
    lives = F.col("key").isNotNull() & F.col("__found").isNotNull() & ~F.col("__found.is_delete")
    return found.select("__asked.*", F.when(lives, F.col("__found.version")).alias("found_version"), F.when(lives, F.col("__found.value")).alias("value"))


def valid_prefix(log: DataFrame) -> DataFrame:
    """The rows of a log before its first damaged one (`ok` false), by version."""
    first_bad = log.agg(F.min(F.when(~F.col("ok"), F.col("version"))).alias("__bad"))
    return log.crossJoin(F.broadcast(first_bad)).where(F.col("__bad").isNull() | (F.col("version") < F.col("__bad"))).drop("__bad")


def replay(checkpoint: DataFrame, log: DataFrame, upto: int) -> DataFrame:
    """The live rows after a checkpoint made at version `upto` and the part of the log after it."""
    return latest(checkpoint.unionByName(log.where(F.col("version") > upto)))


def delete_existed(log: DataFrame) -> DataFrame:
    """key, version, existed of each delete: whether the key lived just before. Every delete takes a version."""
    rows = previous(log.select("key", "version", "is_delete"), "__before", "key", "version", F.struct("is_delete"))
    return rows.where("is_delete").select("key", "version", F.coalesce(~F.col("__before.is_delete"), F.lit(False)).alias("existed"))


def stats(log: DataFrame) -> DataFrame:
    """commit_version, live_keys, live_bytes, log_bytes and whether a store of that size meets 4 L + 65536 bytes."""
    size = F.octet_length(F.col("key").cast("string")) + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    whole = log.agg(F.max("version").alias("commit_version"), F.sum(size).cast("long").alias("log_bytes"))
    live = latest(log).agg(F.count(F.lit(1)).alias("live_keys"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("live_bytes"))
    return whole.crossJoin(live).withColumn("within_bound", F.col("log_bytes") <= 4 * F.col("live_bytes") + 65536)


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """The rows of pandas batches, one after the other."""
    for pdf in batches:
        yield from pdf.itertuples(index=False)

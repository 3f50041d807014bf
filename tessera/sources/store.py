"""A versioned key/value store on Parquet: commits, snapshots, transactions, checkpoints and recovery.

    store/log/version=N/       the rows of commit N: key, value, is_delete
    store/checkpoint/upto=N/   the live rows as of version N, with their versions

A commit is written to a name of its own and renamed to version=N, which is what makes it visible, all or nothing;
a rename onto a commit that someone else made first fails, and the commit is tried with the next number after a new
check for conflicts. Reads at a snapshot take the newest checkpoint at or below it and only the commits after it, by
partition pruning on the version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import versioned as kv

ENTRY = "key string, value string, is_delete boolean"


class StoreError(Exception):
    """What the store refuses."""


class ConflictError(StoreError):
    """Another commit wrote a key of the transaction after its snapshot; its writes are dropped."""


class CorruptStoreError(StoreError):
    """A checkpoint cannot be read, or is not one."""


class ClosedError(StoreError):
    """The transaction has ended."""


class VersionedStore:
    """One store under a folder that Spark can write."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._active: list[int] = []
        self._fs.mkdirs(self._path("log"))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        """Numbers of the complete folders prefix=N; one without a success mark is a commit that never was."""
        at = self._path(folder)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix) and self._fs.exists(self._path(f"{folder}/{n}/_SUCCESS")))

    def version(self) -> int:
        """The last commit's number, 0 before the first."""
        return max([0, *self._numbers("log", "version="), *self._numbers("checkpoint", "upto=")])

    def _checkpoint(self, upto: int) -> DataFrame:
        """A checkpoint's rows. The footers of its files are read first: a damaged one, or other columns, is an error."""
        path = f"{self.folder}/checkpoint/upto={upto}"
        try:
            columns = self.spark.read.option("mergeSchema", True).parquet(path).columns
        except Exception as e:  # of the footers' readers, in the driver or in a task
            raise CorruptStoreError(f"the checkpoint at version {upto} cannot be read") from e
        if set(columns) != {"key", "value", "is_delete", "version"}:
            raise CorruptStoreError(f"the checkpoint at version {upto} has the columns {columns}")
        return self.spark.read.schema(f"{ENTRY}, version long").parquet(path)

    def _rows(self, snapshot: int, after: int = -1) -> DataFrame:
        """key, version, value, is_delete of the commits up to a snapshot, on top of a checkpoint."""
        parts = []
        base = max([n for n in self._numbers("checkpoint", "upto=") if n <= snapshot], default=0)
        if base and after < base:
            parts.append(self._checkpoint(base).where(F.col("version") > after))
        log = [n for n in self._numbers("log", "version=") if max(base, after) < n <= snapshot]
        if log:
            read = self.spark.read.schema(f"{ENTRY}, version long").option("basePath", f"{self.folder}/log")
            parts.append(read.parquet(*(f"{self.folder}/log/version={n}" for n in log)))
        out = self.spark.createDataFrame([], f"{ENTRY}, version long")
        for p in parts:
            out = out.unionByName(p)
        return out.select("key", "version", "value", "is_delete")

    def scan(self, prefix: str = "", snapshot: int | None = None) -> DataFrame:
        """key, value of the live keys with a prefix, in their order."""
        rows = self._rows(self.version() if snapshot is None else snapshot)
        return kv.prefix_scan(kv.latest(rows.where(F.startswith("key", F.lit(prefix)))), "key", prefix).select("key", "value")

    def get(self, key: str, snapshot: int | None = None) -> str | None:
        """The value of a key, or None."""
        rows = self._rows(self.version() if snapshot is None else snapshot).where(F.col("key") == key)
        found = kv.latest(rows).first()
        return found and found["value"]

    def put(self, key: str, value: str) -> None:
        self.write(self.spark.createDataFrame([(key, value, False)], ENTRY))

    def delete(self, key: str) -> bool:
        """Whether the key lived; takes a version in any case."""
        existed = self.get(key) is not None
        self.write(self.spark.createDataFrame([(key, None, True)], ENTRY))
        return existed

    def write(self, entries: DataFrame, snapshot: int | None = None) -> int:
        """Commits key, value, is_delete at once and returns the version; with a snapshot, first committer wins."""
        bad = kv.invalid_entries(entries.select("key", "value")).first()
        if bad is not None:
            raise StoreError(bad["reason"])
        staged = f"staged-{uuid.uuid4().hex}"
        entries.select("key", "value", "is_delete").write.parquet(f"{self.folder}/{staged}")
        while True:
            last = self.version()
            if snapshot is not None and last > snapshot:
                mine = self.spark.read.schema(ENTRY).parquet(f"{self.folder}/{staged}").select("key")
                if self._rows(last, after=snapshot).join(mine, "key", "left_semi").limit(1).count():
                    self._fs.delete(self._path(staged), True)
                    raise ConflictError("a key was written after the snapshot")
            target = self._path(f"log/version={last + 1}")
            if not self._fs.exists(target) and self._fs.rename(self._path(staged), target):
                return last + 1

    def begin(self) -> Transaction:
        """A transaction on a snapshot of now."""
        self._active.append(at := self.version())
        return Transaction(self, at)

    def checkpoint(self) -> int:
        """Writes the live rows and drops the log; what open snapshots need of it stays."""
        last = self.version()
        keep = kv.horizon(last, self._active)
        if keep and keep not in self._numbers("checkpoint", "upto="):
            live = kv.latest(self._rows(keep)).withColumn("is_delete", F.lit(False))
            live.select("key", "value", "is_delete", "version").sort("key").write.mode("overwrite").parquet(f"{self.folder}/checkpoint/upto={keep}")
        for folder, prefix, old in (("log", "version=", lambda n: n <= keep), ("checkpoint", "upto=", lambda n: n < keep)):
            for n in self._numbers(folder, prefix):
                if old(n):
                    self._fs.delete(self._path(f"{folder}/{prefix}{n}"), True)
        return keep

    def stats(self) -> dict[str, int]:
        """Commit and checkpoint versions, live keys, open transactions and bytes on disk."""
        last = self.version()
        size = lambda name: self._fs.getContentSummary(self._path(name)).getLength() if self._fs.exists(self._path(name)) else 0
        upto = max(self._numbers("checkpoint", "upto="), default=0)
        return {"commit_version": last, "checkpoint_version": upto, "live_keys": kv.latest(self._rows(last)).count(), "open_transactions": len(self._active), "log_bytes": size("log"), "total_bytes": size("")}


class Transaction:
    """Reads of a snapshot with the transaction's own writes over it."""

    def __init__(self, store: VersionedStore, snapshot: int) -> None:
        self.store, self.snapshot, self._own, self._open = store, snapshot, {}, True

    def _check(self) -> None:
        if not self._open:
            raise ClosedError("the transaction has ended")

    def get(self, key: str) -> str | None:
        self._check()
        return self._own[key] if key in self._own else self.store.get(key, self.snapshot)

    def put(self, key: str, value: str) -> None:
        self._check()
        self._own[key] = value

    def delete(self, key: str) -> bool:
        """Whether the key was visible to the transaction."""
        existed = self.get(key) is not None
        self._own[key] = None
        return existed

    def _writes(self) -> DataFrame:
        return self.store.spark.createDataFrame([(k, v, v is None) for k, v in sorted(self._own.items())], ENTRY)

    def scan(self, prefix: str = "") -> DataFrame:
        self._check()
        own = self._writes().where(F.startswith("key", F.lit(prefix)))
        return kv.overlay(self.store.scan(prefix, self.snapshot), own).orderBy("key")

    def commit(self) -> None:
        """Without writes it always succeeds; ConflictError ends the transaction."""
        self._check()
        self._end()
        if self._own:
            self.store.write(self._writes(), self.snapshot)

    def rollback(self) -> None:
        if self._open:
            self._end()

    def _end(self) -> None:
        self._open = False
        self.store._active.remove(self.snapshot)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()
        else:
            self.rollback()

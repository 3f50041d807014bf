"""Exact deduplication with a log-structured merge index over text digests (DataFrame functions only).

A batch of documents is added in these steps. Flush: each input task is a memtable and writes one run of level 0,
sorted by digest, without a shuffle. Compaction of the flush makes one run of level 1: an entry for each digest, with
the identifier that stays and the group's size, sorted by digest, and a filter. Probe: the batch's digests are looked
up in the filters of all older runs, and only those that pass are joined with a run's entries, so an older run is
joined with the batch's hits and not with the batch. Merge: where FAN runs share a level, their entries are merged
into one run of the next level, which keeps the smallest identifier (or the largest) and adds the sizes up.

A run's filter is a blocked Bloom filter held as a table: a digest belongs to one slot of 64 bits and sets four of
them; about 10 bits for each entry let 1 to 3 in 100 strange digests pass. It is a hundredth of the texts in size and
is joined by slot, so it needs to fit in no single task.

Every hit (a digest of two rows or more) is verified on the bytes of the texts, and a digest that different texts
share is split by the texts themselves.

Defined cases: a null text counts as empty; a very long text is one row, of which only the digest is moved unless its
digest is a hit; an empty table gives no rows; rows equal in id and text are one
document and give one row, while group_size counts all rows; with keep="max" the largest id of equal texts
stays, with keep="min" the smallest, so ties between texts are decided by id alone; a null id never stays before
another id. Further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, apply_decisions, doc_text, lookup, shared_folder, without, written

#: Runs of a level that are merged into one of the next.
FAN = 2
#: Bits of a filter for each entry.
FILTER_BITS = 10


def sha256_of(text: Column) -> Column:
    """The 32-byte SHA-256 of a text in UTF-8."""
    return F.unhex(F.sha2(text, 256))


def _signature(entries: DataFrame, slots: int) -> DataFrame:
    """`entries` with the slot of each digest and the four bits (some may coincide) that it sets there."""
    h = F.xxhash64("digest")
    bits = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(h, {6 * i}) & 63 AS INT))" for i in range(4))
    return entries.withColumn("h", h).withColumns({"slot": F.expr(f"pmod(shiftrightunsigned(h, 24), {slots}L)"), "bits": F.expr(bits)}).drop("h")


@dataclass
class Run:
    """A sorted run: entries (digest, keep_id, group_size) and their filter (slot, mask)."""

    entries: DataFrame
    filter: DataFrame
    slots: int

    def may_hold(self, digests: DataFrame) -> DataFrame:
        """The `digests` (digest) that the filter lets pass: all that the run holds, and few others."""
        asked = _signature(digests, self.slots).join(self.filter, "slot")
        return asked.where("bits & mask = bits").select("digest")

    def find(self, digests: DataFrame) -> DataFrame:
        """Entries of the run for `digests`. Few that pass the filter are broadcast, so the run is not moved."""
        asked = self.may_hold(digests)
        few = asked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        return self.entries.join(F.broadcast(asked) if few else asked, "digest", "left_semi")


class DigestIndex:
    """A log-structured merge index from text digests to the document that stays."""

    def __init__(self, spark, keep: str = "min", digest=sha256_of) -> None:
        if keep not in ("max", "min"):
            raise ValueError("keep is 'max' or 'min'")
        self.folder, self.digest, self.best = shared_folder(spark), digest, F.max if keep == "max" else F.min
        #: levels[k]: the runs of level k + 1, oldest first
        self.levels: list[list[Run]] = []
        self.flushed: list[DataFrame] = []
        self.made = 0

    def runs(self) -> list[Run]:
        """All runs."""
        return [r for level in self.levels for r in level]

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Writes one sorted run (doc_id, digest) for each task that reads `docs`; no shuffle."""
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), self.digest(doc_text(text_col)).alias("digest"))
        self.flushed.append(written(rows.sortWithinPartitions("digest"), self.folder, f"level0-{len(self.flushed)}"))
        return self.flushed[-1]

    def _run(self, entries: DataFrame) -> Run:
        """Writes entries, sorted, and the filter over them."""
        self.made += 1
        entries = written(entries.sortWithinPartitions("digest"), self.folder, f"run-{self.made}")
        slots = max(1, math.ceil(entries.count() * FILTER_BITS / 64))
        marks = _signature(entries.select("digest"), slots).groupBy("slot").agg(F.expr("bit_or(bits)").alias("mask"))
        return Run(entries, written(marks, self.folder, f"filter-{self.made}"), slots)

    def _merged(self, parts: list[DataFrame]) -> DataFrame:
        """One entry for each digest of several tables of entries, pre-aggregated before the shuffle."""
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.groupBy("digest").agg(self.best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds a batch; returns the entries that older runs have for its digests: digest, keep_id, group_size."""
        flushed = self.flush(docs, id_col, text_col)
        new = self._run(self._merged([flushed.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))]))
        seen = [r.find(new.entries.select("digest")) for r in self.runs()]
        hits = written(self._merged(seen) if seen else new.entries.limit(0), self.folder, f"hits-{self.made}")
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < FAN:
                return hits
            new, self.levels[level], level = self._run(self._merged([r.entries for r in self.levels[level]])), [], level + 1

    def entries(self) -> DataFrame:
        """One entry for each digest over all runs; only where levels are left unmerged is this more than a read."""
        runs = self.runs()
        return runs[0].entries if len(runs) == 1 else written(self._merged([r.entries for r in runs]), self.folder, f"entries-{self.made}")

    def collisions(self, docs: DataFrame, entries: DataFrame, text_col: str = "text") -> DataFrame:
        """Digests that different texts share. Only hits are read again, and each task folds a group of
        copies to its smallest and largest text, so a hot group never meets in one task."""
        hits = entries.where("group_size > 1").select("digest")
        hits = F.broadcast(hits) if hits.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else hits
        texts = docs.select(doc_text(text_col).alias("text")).withColumn("digest", self.digest(F.col("text")))
        ends = texts.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b"))
        return ends.where("a <> b").select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest=sha256_of, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept, collided.

    `docs` goes into the index in `batches`, dealt by a hash of the id; the result is the same for any number of them.
    """
    index = DigestIndex(docs.sparkSession, keep, digest)
    for b in range(batches):
        index.add(docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(batches)) == b), id_col, text_col)
    flushed = index.flushed[0]
    for more in index.flushed[1:]:
        flushed = flushed.unionByName(more)
    merged = index.entries()
    bad = written(index.collisions(docs, merged, text_col), index.folder, "collisions")
    shared = bad.limit(1).count()
    good = lookup(flushed.distinct(), merged, "digest", "group_size")
    if shared:
        good = without(good, bad, ["digest"])
    good = good.withColumn("collided", F.lit(False))
    if shared:  # the bytes of the texts decide
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))
        rows = rows.withColumn("digest", digest(F.col("text"))).join(bad, "digest", "left_semi")
        groups = rows.groupBy("digest", "text").agg(index.best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        split = rows.distinct().join(groups, ["digest", "text"]).drop("text").withColumn("collided", F.lit(True))
        good = good.unionByName(split)
    return good.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """`docs` less its copies: of equal texts one row stays, with all its columns."""
    found = exact_dedup(docs, id_col, text_col, keep).withColumnRenamed("digest", "mark")
    return apply_decisions(docs, found, sha256_of(doc_text(text_col)), True, id_col)


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`; the largest doc_id of equal texts stays."""
    from tessera.sources.tables import table

    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

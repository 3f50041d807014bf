"""Ranked lexical search: a bounded set of items against all documents, by windowed bucket scoring.

Postings are made in one scan: for each document its number of terms and, of the terms that items hold, the numbers and
counts. They are written as tables, whose partitions are segments. A segment is traversed in windows of WINDOW documents in the
order of their ids: a window's postings are turned by term, a term's contribution to each document is made
once, and each item adds the contributions of its terms into an array of the window's size, with a bit for each slot that was
hit. The occupied slots that beat the item's heap are harvested into it, and only they are cleared. A heap of an item keeps DEPTH documents; heaps of all
segments are merged by Spark.

Documents are scored where their postings lie, so no document, term or source is gathered anywhere: what leaves a segment is
DEPTH rows for an item at most. Only items and their terms are broadcast, in blocks of at most BLOCK items and TERMS
distinct terms, and a further block takes another scan, which is little beside its scoring. Sums are exact integers, so the
result does not depend on the partitioning.

Defined cases: a null text has no terms, like an empty one, and neither counts in N nor is found; a very long text is cut into
terms whole, in one row; equal scores rank by ascending doc_id, null ids last; rows that share an id, repeated rows among them, are
ranked each; items without terms, or whose terms no document holds, get no rows; items that share an id are one
item with the terms of all; an item with a null id is an item like others; empty tables give no rows; further columns, of
whatever name, are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.llm.common import shared_folder, small_batches, written

#: Documents of an item's answer.
DEPTH = 10
#: Documents in a window: an array of as many sums fits a core's cache.
WINDOW = 1 << 13
#: Postings after which a window ends early, which bounds the memory of long documents.
CELLS = 4_000_000
#: Items, and distinct terms of them, that are broadcast at once.
BLOCK, TERMS = 10_000, 500_000
#: Ids of documents are compared as they are; a null one comes after all.
LAST = np.iinfo(np.int64).max

#: Bytes of terms: digits and letters, A-Z lowered, and all of non-ASCII characters; others are blanks.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order and with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def blocks_of(items: DataFrame, id_col: str, text_col: str, most: int = BLOCK, most_terms: int = TERMS) -> Iterator[list[tuple[object, Counter]]]:
    """Items with the counts of their terms, in blocks; the driver holds one block at a time."""
    block, seen = {}, set()
    for row in items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).orderBy("item_id").toLocalIterator():
        if row.item_id not in block and (len(block) >= most or len(seen) >= most_terms):
            yield list(block.items())
            block, seen = {}, set()
        counts = Counter(terms(row.text))
        block.setdefault(row.item_id, Counter()).update(counts)
        seen.update(counts)
    if block:
        yield list(block.items())


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the document), terms (numbers of those in `vocabulary`) and tfs, for documents with terms."""
    spread = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = spread.value
        for pdf in batches:
            found = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = terms(text)
                if words:
                    counts = Counter(filter(number.__contains__, words))
                    found.append((doc_id, len(words), np.array([number[t] for t in counts], np.int32), np.fromiter(counts.values(), np.int64, len(counts))))
            out = pd.DataFrame(found, columns=["doc_id", "n", "terms", "tfs"])
            yield out.astype({"doc_id": "Int64", "n": "int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(post, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    """A term's weight, in thousandths."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """The heaps of all items over the windows of one segment."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, depth: int):
        self.items, self.weights, self.n_docs, self.n_terms, self.depth = items, weights, n_docs, n_terms, depth
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in items]  # (score, -id), least first
        self.sums, self.hit = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, bool)

    def add(self, rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """Scores one window: documents (id, n, terms, tfs) by ascending id."""
        ids, n, numbers, tfs = zip(*rows, strict=True)
        slots = np.repeat(np.arange(len(ids)), [len(x) for x in numbers])
        n, numbers, tfs = np.array(n, np.int64), np.concatenate(numbers).astype(np.int64), np.concatenate(tfs).astype(np.int64)
        m = 25 + 75 * n * self.n_docs // self.n_terms
        gained = self.weights[numbers] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[slots]))
        order = np.argsort(numbers, kind="stable")  # by term, and by slot in it
        slots, gained = slots[order], gained[order]
        held, starts = np.unique(numbers[order], return_index=True)
        lists = {int(t): (slots[a:b], gained[a:b]) for t, a, b in zip(held, starts, [*starts[1:], len(order)], strict=True)}
        for (mine, times), heap in zip(self.items, self.heaps, strict=True):
            for t, k in zip(mine, times, strict=True):
                if t in lists:
                    at, gain = lists[t]
                    self.sums[at] += gain if k == 1 else gain * k  # a term has a slot once
                    self.hit[at] = True
            found = np.flatnonzero(self.hit)
            if len(found):
                self.harvest(found, ids, heap)

    def harvest(self, found: np.ndarray, ids: tuple[int, ...], heap: list[tuple[int, int]]) -> None:
        """Moves the occupied slots that are good enough into the heap, and clears all of them."""
        scores = self.sums[found]
        self.sums[found], self.hit[found] = 0, False
        least = heap[0][0] if len(heap) == self.depth else 1
        if len(scores) > 4 * self.depth:  # the best of the window, with all that equal the last of them
            least = max(least, np.partition(scores, -self.depth)[-self.depth])
        good = scores >= least
        for slot, score in zip(found[good].tolist(), scores[good].tolist(), strict=True):
            entry = (score, -ids[slot])
            if len(heap) < self.depth:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)


def best_of_segments(posted: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, depth: int = DEPTH) -> DataFrame:
    """item (its number), doc_id, score: each segment's best documents of each item."""
    spread = posted.sparkSession.sparkContext.broadcast((items, weights))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, window, size = Segment(*spread.value, n_docs, n_terms, depth), [], 0
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64").fillna(LAST).astype("int64").tolist()
            for row in zip(ids, pdf["n"].tolist(), pdf["terms"], pdf["tfs"], strict=True):
                if len(window) == WINDOW or size >= CELLS:
                    segment.add(window)
                    window, size = [], 0
                window.append(row)
                size += len(row[2])
        if window:
            segment.add(window)
        rows = [(k, None if -doc == LAST else -doc, s) for k, heap in enumerate(segment.heaps) for s, doc in heap]
        for at in range(0, len(rows), 100_000):
            yield pd.DataFrame(rows[at : at + 100_000], columns=["item", "doc_id", "score"]).astype({"doc_id": "Int64"})

    # segments are partitions of the table, sorted where they lie
    return posted.where(F.size("terms") > 0).sortWithinPartitions(F.asc_nulls_last("doc_id")).mapInPandas(score, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", depth: int = DEPTH, block: int = BLOCK, most_terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's best documents with a score above 0."""
    spark = docs.sparkSession
    small_batches(spark)
    folder, found, totals = shared_folder(spark), None, None
    kind = items.schema[item_col].dataType
    for b, rows in enumerate(blocks_of(items, item_col, text_col, block, most_terms)):
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*(c for _, c in rows))))}
        posted = written(postings(docs, vocabulary, id_col, text_col), folder, f"postings-{b}")
        if totals is None:
            totals = posted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        if not totals.n:
            break
        df = posted.select(F.explode("terms").alias("term")).groupBy("term").count()
        weights = np.zeros(len(vocabulary), np.int64)
        for row in df.toLocalIterator():  # one row for each term of the items, TERMS at most and those of one item
            weights[row["term"]] = weight(totals.n, row["count"])
        ready = [(np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in rows]
        part = best_of_segments(posted, ready, weights, totals.n, totals.terms, depth)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(rows)], StructType([StructField("item", LongType()), StructField("item_id", kind)]))
        part = part.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= depth).select("item_id", "rank", "doc_id", "score")


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `benchmark` and `documents`."""
    from tessera.sources.tables import table

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), docs AS (
  SELECT rid, doc_id, terms, len(terms)::BIGINT AS n FROM cut WHERE len(terms) > 0
), total AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs
), asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), tf AS (
  SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, n, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs
), scored AS (
  SELECT item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), total GROUP BY ALL
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

"""Token ids as Parquet list columns that are cheap to read in part.

A token file is a folder of Parquet parts in ascending document order. Each part has one row per document:
part, doc_id, n_tokens and ids (a list of ints that ends with the end id). Row groups and pages are kept small
and the column and page indexes are written, so that a reader of a few documents, or of doc_id and n_tokens
alone, skips the rest. Ids are dictionary encoded by default (a bit-packed index into the few ten thousand ids
of a row group) or, with encoding="delta", delta encoded.

Documents are dealt out by ranges of doc_id, so no task holds more than its range and the order of the parts is
that of the ids; the number of parts follows the bytes of text. The number of ids before a document is the sum of the parts before its own plus a running sum
inside its part; only one number for each part meets in one task.

Defined cases: a null text counts as empty and has the end id alone; a very long text is one row, encoded whole, in a
batch that its bytes close; an empty table makes an empty file; rows with the same id (ties) are in the order of a hash
of their texts, repeated rows each have ids of their own; a null id comes first; further columns are ignored.
"""

from __future__ import annotations

import functools
import math
import os
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import default_path, pieces_of
from tessera.llm.common import doc_text, shared_folder, small_batches

SCHEMA = "part int, doc_id long, n_tokens int, ids array<int>"
#: Signs, a run of which makes a pre-token of its own after letters.
_SIGNS = string.punctuation
#: Bytes of text in a part, about, once there are more of them than shuffle partitions.
PART_BYTES = 64 << 20
#: Pieces of text whose ids a worker keeps, in two halves of which the older one goes.
CACHE = 800_000
#: Texts encoded at once.
SLICE = 500


def write_options(encoding: str = "dictionary", row_group_mb: int = 16, page_kb: int = 256) -> dict[str, str]:
    """Parquet writer options of a token file."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError("encoding is 'dictionary' or 'delta'")
    return {
        "compression": "zstd",
        "parquet.block.size": str(row_group_mb << 20),
        "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": "2000",
        "parquet.dictionary.page.size": str(2 << 20),
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
        "parquet.column.index.enabled": "true",
    }


class PieceEncoder:
    """The tokenizers library's ids of whole texts, made of what it gives for their pieces.

    Texts are cut at white space, which no pre-token of the vocabulary spans; the library encodes the pieces that a
    worker has not kept. Letters followed by ASCII signs are two pre-tokens and are asked for apart. Pieces of letters are
    encoded many at a time and their ids told apart by the end-of-word tokens; letters that normalisation turns into more
    than one pre-token make these more than expected, and then, as for all other pieces, each is encoded by itself. A text
    with special tokens inside goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.is_end = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _library(self, new: list[str]) -> None:
        """Keeps what the library gives for pieces."""
        plain, rest = [], []
        for p in new:
            (plain if p.isalpha() else rest).append(p)
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            ids = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<i4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(some):
                rest += some
                continue
            raw, begin = ids.tobytes(), 0
            for p, stop in zip(some, (4 * ends).tolist(), strict=True):
                self.kept[p] = raw[begin:stop]
                begin = stop
        for at in range(0, len(rest), 5000):
            some = rest[at : at + 5000]
            for p, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.kept[p] = array("i", e.ids).tobytes()

    def _learn(self, new: set[str]) -> None:
        """Keeps the ids of pieces; letters and the signs after them are pre-tokens of their own, so kept apart."""
        kept, older, ask, split = self.kept, self.older, set(), []
        for p in new:
            stem = p.rstrip(_SIGNS)
            if len(stem) < len(p) and stem.isalpha() and stem[-1] < "\u0250":
                signs = p[len(stem) :]
                split.append((p, stem, signs))
                ask.add(stem)
                ask.add(signs)
            else:
                ask.add(p)
        ask -= kept.keys()
        for p in ask & older.keys():
            kept[p] = older[p]
        self._library([p for p in ask if p not in kept])
        for p, stem, signs in split:
            kept[p] = kept[stem] + kept[signs]

    def encode(self, texts: list[str], end_id: int) -> list[bytes]:
        """The ids of each text with the end id, as 32-bit integers in memory."""
        if len(self.kept) > CACHE // 2:
            self.kept, self.older = {}, self.kept
        kept, older, cut, new = self.kept, self.older, [], set()
        for t in texts:
            if any(s in t for s in self.special):
                cut.append((None, None))
                continue
            pieces = pieces_of(t)
            parts = list(map(kept.get, pieces))
            if None in parts:
                new.update([p for p, q in zip(pieces, parts, strict=True) if q is None])
            else:
                pieces = None
            cut.append((pieces, parts))
        for p in new & older.keys():
            kept[p] = older[p]
        self._learn(new - kept.keys())
        out, end = [], array("i", [end_id]).tobytes()
        for t, (pieces, parts) in zip(texts, cut, strict=True):
            if parts is None:
                whole = array("i", self.library.encode(t, add_special_tokens=False).ids).tobytes()
            else:
                whole = b"".join(parts if pieces is None else [kept[p] if q is None else q for p, q in zip(pieces, parts, strict=True)])
            out.append(whole + end)
        return out


@functools.lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder for each worker process."""
    return PieceEncoder(path)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", **layout) -> DataFrame:
    """Encodes every whole text and writes the token file to `folder`; returns the file read back."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                ids = coder.encode(some.column("text").to_pylist(), end_id)
                sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
                offsets = np.concatenate((np.zeros(1, np.int32), sizes.cumsum(dtype=np.int32)))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([some.column("part"), some.column("doc_id"), pa.array(sizes), lists], names=["part", "doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / PART_BYTES))
    # an id that many rows share is dealt over parts by its texts, and equal rows by where they were read
    rows = rows.withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(parts, "doc_id", "h", "at").sortWithinPartitions("doc_id", "h", "at").drop("h", "at")
    ranged.withColumn("part", F.spark_partition_id()).mapInArrow(run, SCHEMA).write.options(**write_options(**layout)).parquet(folder)
    return read_tokens(spark, folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """part, doc_id, n_tokens, ids of a token file."""
    return spark.read.schema(SCHEMA).parquet(folder)


def with_offsets(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """`found` (part, place, doc_id, n_tokens and more columns) with start: the ids of all documents before, by the
    sizes in the token file, of which only part and n_tokens are read for the sums of parts."""
    parts = tokens.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("__all"))
    # one row for each part; a part has PART_BYTES of text or there are no more of them than shuffle partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("__all").over(before), F.lit(0)).cast("long").alias("__before"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    run = found.withColumn("__run", F.coalesce(F.sum(F.col("n_tokens").cast("long")).over(inside), F.lit(0)))
    return run.join(F.broadcast(parts), "part").withColumn("start", F.col("__before") + F.col("__run")).drop("__before", "__run")


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of a token file, from what is in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, values = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(), dtype="<i4")).cast("B")
            crcs = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            sizes = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), sizes, pa.array(crcs, pa.int64()), batch.column("place")], names=["part", "doc_id", "n_tokens", "ids_crc32", "place"])

    # rows with the same id keep their order in the file
    rows = tokens.select("part", "doc_id", "ids", F.col("_metadata.row_index").alias("place"))
    rows = rows.mapInArrow(run, "part int, doc_id long, n_tokens long, ids_crc32 long, place long")
    return with_offsets(rows, tokens).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_token_file(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`, from the token file as read back; end id 2."""
    from tessera.sources.tables import table

    folder = f"{shared_folder(spark)}/tokens"
    return token_digests(write_tokens(table(spark, sf_dir, "documents"), folder, default_path(), end_id=2))

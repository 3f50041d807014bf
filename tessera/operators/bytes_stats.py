"""Statistics of bytes and a bounded-state codec for streams of records."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The longest code in bits.
LONGEST = 15
#: Bytes of a stream coded at a time, and the window (a power of two) that matches reach back over.
BLOCK, WINDOW_BITS = 8192, 13
#: Bytes of a text that are counted at a time, and keys whose counts a task holds.
SLICE, KEYS = 1 << 20, 1024
#: What adding one occurrence counts for in contextual counts.
HIT = 16


def byte_histogram(rows: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """by, byte, n over all bytes of a text or binary column; counted in each task before the shuffle. A null `by` is a key like others."""
    keys = [by] if by else []
    data = rows.select(*keys, F.col(column).cast("binary").alias("__bytes")).where("__bytes IS NOT NULL")
    kind = f"{by} {dict(rows.dtypes)[by]}, " if by else ""
    return data.mapInArrow(lambda batches: count_bytes(batches, by), f"{kind}byte int, n long").groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def count_bytes(batches: Iterable[pa.RecordBatch], by: str | None) -> Iterator[pa.RecordBatch]:
    """by, byte, n of batches whose last column is binary and whose first one, if `by` is given, is the key.

    What is held is a batch as Arrow made it and the counts of KEYS keys; SLICE bytes are counted at a time, as numpy widens what it counts.
    """
    totals: dict = {}
    of = None

    def told() -> pa.RecordBatch:
        at = [np.flatnonzero(n) for n in totals.values()]
        columns = {by: pa.array([key for key, found in zip(totals, at, strict=True) for _ in found], of)} if by else {}
        columns["byte"] = pa.array(np.concatenate(at).astype("int32"))
        columns["n"] = pa.array(np.concatenate([n[found] for n, found in zip(totals.values(), at, strict=True)]))
        return pa.RecordBatch.from_pydict(columns)

    for batch in batches:
        of = batch.column(0).type
        for i, value in enumerate(batch.column(batch.num_columns - 1)):
            key = batch.column(0)[i].as_py() if by else None
            if key not in totals and len(totals) == KEYS:
                yield told()
                totals = {}
            raw, n = np.frombuffer(value.as_buffer(), np.uint8), totals.setdefault(key, np.zeros(256, np.int64))
            for at in range(0, len(raw), SLICE):
                n += np.bincount(raw[at : at + SLICE], minlength=256)
    if totals:
        yield told()


def context_counts(rows: DataFrame, column: str) -> DataFrame:
    """context, byte, n: bytes by the two top bits of the byte before (0 at a row's start), HIT for each."""
    data = rows.select(F.col(column).cast("binary").alias("__bytes")).where("__bytes IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total = np.zeros(1024, np.int64)
            for raw in pdf["__bytes"]:
                whole, before = np.frombuffer(raw, np.uint8), 0
                for at in range(0, len(whole), SLICE):
                    b = whole[at : at + SLICE].astype(np.int64)
                    total += np.bincount(np.concatenate(([before], b[:-1] >> 6)) * 256 + b, minlength=1024)
                    before = b[-1] >> 6
            at = np.flatnonzero(total)
            yield pd.DataFrame({"context": (at >> 8).astype("int32"), "byte": (at & 255).astype("int32"), "n": total[at] * HIT})

    return data.mapInPandas(count, "context int, byte int, n long").groupBy("context", "byte").agg(F.sum("n").alias("n"))


def code_lengths(counts: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Huffman code lengths; counts are halved (rounded up) until no code is longer than `longest`."""
    counts = {s: c for s, c in counts.items() if c > 0}
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    while True:
        heap = [(c, s, (s,)) for s, c in counts.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(counts, 0)
        while len(heap) > 1:
            (a, i, x), (b, j, y) = heapq.heappop(heap), heapq.heappop(heap)
            for s in x + y:
                depth[s] += 1
            heapq.heappush(heap, (a + b, min(i, j), x + y))
        if max(depth.values()) <= longest:
            return depth
        counts = {s: c + 1 >> 1 for s, c in counts.items()}


def huffman_sizes(histogram: DataFrame, by: str) -> DataFrame:
    """by, bytes, coded: the size before and after Huffman coding, stored as it is if that is smaller."""

    def size(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = dict(zip(pdf["byte"], pdf["n"].astype(int), strict=True))
        lengths, total = code_lengths(counts), sum(counts.values())
        coded = -(-sum(counts[s] * n for s, n in lengths.items()) // 8)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "bytes": [total], "coded": [min(coded, total)]})

    # at most 256 rows in a group
    return histogram.groupBy(by).applyInPandas(size, f"{by} {dict(histogram.dtypes)[by]}, bytes long, coded long")


def entropy_bytes(histogram: DataFrame, by: str) -> DataFrame:
    """by, bytes, bound: the size, and the fewest bytes that a code of single bytes can take."""
    totals = histogram.groupBy(by).agg(F.sum("n").alias("bytes"))
    rows = histogram.join(totals, by)
    return rows.groupBy(by, "bytes").agg((F.sum(-F.col("n") * F.log2(F.col("n") / F.col("bytes"))) / 8).alias("bound"))


def varint_length(value: Column) -> Column:
    """Bytes of a non-negative long in groups of seven bits."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 7)).cast("int")


def varint_hex(value: Column) -> Column:
    """The groups of seven bits of a non-negative long as hex, the lowest first; all but the last have their top bit set."""
    last = varint_length(value) - 1
    group = lambda i: F.call_function("shiftright", value, 7 * i).bitwiseAND(127).bitwiseOR(F.when(i < last, 128).otherwise(0))
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(group(i)), 2, "0")), "")


def bucket(value: Column, base: list[int]) -> tuple[Column, Column]:
    """The number of the last base at or below a value, and what is left over for extra bits."""
    below = F.filter(F.array(*map(F.lit, base)), lambda b: b <= value)
    return F.size(below) - 1, value - F.element_at(below, -1)


class CorruptStream(ValueError):
    """A stream that is cut short or damaged."""


_MAGIC = b"TS1"
_END, _CODED, _STORED = 0, 1, 2


def compress(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The frame of a byte stream in one pass: blocks of BLOCK bytes, each coded or, if that is no smaller, stored.

    A block is raw DEFLATE of zlib with the window as its dictionary, in place of the adaptive model and match search of
    the surveyed codec. The state is the window and one block, whatever the stream's length, and the blocks do not depend on how
    the stream was cut into chunks. A stored block still enters the window of the next ones.
    """
    yield _MAGIC
    window, pending, crc, size = b"", bytearray(), 0, 0

    def block(raw: bytes, window: bytes) -> bytes:
        coder = zlib.compressobj(9, zlib.DEFLATED, -WINDOW_BITS, 5, zlib.Z_DEFAULT_STRATEGY, window) if window else zlib.compressobj(9, zlib.DEFLATED, -WINDOW_BITS, 5)
        coded = coder.compress(raw) + coder.flush()
        if len(coded) < len(raw):
            return struct.pack("<BHH", _CODED, len(raw) - 1, len(coded)) + coded
        return struct.pack("<BH", _STORED, len(raw) - 1) + raw

    for chunk in chunks:
        pending += chunk
        while len(pending) >= BLOCK:
            raw = bytes(pending[:BLOCK])
            del pending[:BLOCK]
            yield block(raw, window)
            window, crc, size = raw[-(1 << WINDOW_BITS) :], zlib.crc32(raw, crc), size + len(raw)
    if pending:
        raw = bytes(pending)
        yield block(raw, window)
        crc, size = zlib.crc32(raw, crc), size + len(raw)
    yield struct.pack("<BIQ", _END, crc, size)


def decompress(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The stream of a frame, block by block; CorruptStream if it is cut short, damaged or followed by more."""
    source, buffer = iter(chunks), bytearray()

    def take(n: int) -> bytes:
        while len(buffer) < n:
            more = next(source, None)
            if more is None:
                raise CorruptStream("the stream is cut short")
            buffer.extend(more)
        out = bytes(buffer[:n])
        del buffer[:n]
        return out

    if take(len(_MAGIC)) != _MAGIC:
        raise CorruptStream("not a frame")
    window, crc, size = b"", 0, 0
    while (tag := take(1)[0]) != _END:
        n = struct.unpack("<H", take(2))[0] + 1
        if tag == _STORED:
            raw = take(n)
        elif tag == _CODED:
            coded = take(struct.unpack("<H", take(2))[0])
            reader = zlib.decompressobj(-WINDOW_BITS, window) if window else zlib.decompressobj(-WINDOW_BITS)
            try:
                raw = reader.decompress(coded, n + 1)
            except zlib.error as e:
                raise CorruptStream(str(e)) from e
            if len(raw) != n:
                raise CorruptStream("a block has another length than it says")
        else:
            raise CorruptStream("unknown block")
        yield raw
        window, crc, size = raw[-(1 << WINDOW_BITS) :], zlib.crc32(raw, crc), size + n
    if struct.unpack("<IQ", take(12)) != (crc, size):
        raise CorruptStream("the checksum differs")
    if buffer or any(source):
        raise CorruptStream("there is more after the end")


def compress_column(column: Column) -> Column:
    """The frame of each value of a text or binary column; null stays null."""

    @F.pandas_udf("binary")
    def code(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else b"".join(compress([v])))

    return code(column.cast("binary"))


def decompress_column(column: Column) -> Column:
    """The bytes of each frame; null stays null, and a damaged frame fails the task."""

    @F.pandas_udf("binary")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else b"".join(decompress([v])))

    return decode(column)

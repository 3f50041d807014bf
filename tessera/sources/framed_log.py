"""A Python data source for commit logs of framed records.

A log file is a run of records: the payload's length and CRC-32 (each an unsigned 32-bit integer, little endian),
then the payload: version (u64), number of entries (u32), and for each entry the key's length (u32), the value's
length (u32, or TOMBSTONE for a delete), the key and the value. Reading a file stops at its first record that is
short, does not match its checksum or does not decode, so what is read is always a prefix of what was committed.

    spark.dataSource.register(FramedLog)
    spark.read.format("framed_log").load(folder)        # version, key, value, is_delete, file, offset

Each file is one partition; files are listed and read by the executors' own file system.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed values of the format: the value length of a delete and the largest payload.
TOMBSTONE = 0xFFFFFFFF
MAX_PAYLOAD = 256 << 20
SCHEMA = "version long, key binary, value binary, is_delete boolean, file string, offset long"


def encode_commit(version: int, entries: Iterable[tuple[bytes, bytes | None]]) -> bytes:
    """One framed record; a value of None is a delete."""
    entries = list(entries)
    body = bytearray(struct.pack("<QI", version, len(entries)))
    for key, value in entries:
        body += struct.pack("<II", len(key), TOMBSTONE if value is None else len(value)) + key + (value or b"")
    return struct.pack("<II", len(body), zlib.crc32(bytes(body))) + bytes(body)


def decode_payload(body: bytes) -> tuple[int, list[tuple[bytes, bytes | None]]]:
    """version and entries; ValueError if the payload is short or has bytes left over."""
    try:
        version, n = struct.unpack_from("<QI", body)
        at, out = 12, []
        for _ in range(n):
            k, v = struct.unpack_from("<II", body, at)
            size = 0 if v == TOMBSTONE else v
            if at + 8 + k + size > len(body):
                raise ValueError("an entry is cut short")
            key = body[at + 8 : at + 8 + k]
            out.append((key, None if v == TOMBSTONE else body[at + 8 + k : at + 8 + k + size]))
            at += 8 + k + size
    except struct.error as e:
        raise ValueError(str(e)) from e
    if at != len(body):
        raise ValueError("bytes are left over")
    return version, out


def read_records(stream) -> Iterator[tuple[int, int, list[tuple[bytes, bytes | None]]]]:
    """offset, version, entries of the good records at the start of a binary file, one in memory at a time."""
    offset = 0
    while True:
        head = stream.read(8)
        if len(head) < 8:
            return
        size, crc = struct.unpack("<II", head)
        if size > MAX_PAYLOAD:
            return
        body = stream.read(size)
        if len(body) < size or zlib.crc32(body) != crc:
            return
        try:
            version, entries = decode_payload(body)
        except ValueError:
            return
        yield offset, version, entries
        offset += 8 + size


def good_length(path: str) -> int:
    """Bytes of a log file up to the end of its last good record: where appending may go on after damage."""
    end = 0
    with open(path, "rb") as f:
        for _ in read_records(f):
            end = f.tell()
    return end


def truncate_tail(path: str) -> int:
    """Cuts a log file after its last good record, so that what is appended can be read again; returns the bytes cut."""
    end = good_length(path)
    cut = os.path.getsize(path) - end
    if cut:
        os.truncate(path, end)
    return cut


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def partitions(self):
        files = sorted(glob.glob(os.path.join(self.path, "*.log"))) if os.path.isdir(self.path) else [self.path]
        return [_File(f) for f in files]

    def read(self, partition: _File):
        with open(partition.path, "rb") as f:
            for offset, version, entries in read_records(f):
                for key, value in entries:
                    yield version, key, value, value is None, partition.path, offset


class FramedLog(DataSource):
    """Format "framed_log"; the path is a log file or a folder of *.log files."""

    @classmethod
    def name(cls) -> str:
        return "framed_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

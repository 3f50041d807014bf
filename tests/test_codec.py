"""The codec: round trips, independence of chunking, damage, bounds; and Huffman lengths."""

import random
import zlib

import pytest

from tessera.operators import bytes_stats as zs


def frame(data):
    return b"".join(zs.compress([data]))


def streams():
    rng = random.Random(1)
    log = b"".join(b"ts=%d.%03d host=web-%d svc=auth lvl=info k=%d msg=\"request served\"\n" % (1700000000 + i, i % 1000, i % 5, rng.randrange(99)) for i in range(4000))
    return {"empty": b"", "one": b"x", "log": log, "random": rng.randbytes(50_000), "repeated": b"a" * 70_000, "cycle": bytes(range(256)) * 300, "block": b"b" * zs.BLOCK, "blocks": b"c" * (2 * zs.BLOCK + 1)}


@pytest.mark.parametrize("name,data", streams().items())
def test_round_trip_and_chunking(name, data):
    whole = frame(data)
    assert b"".join(zs.decompress([whole])) == data
    rng = random.Random(2)
    for _ in range(3):
        chunks, at = [], 0
        while at < len(data):
            n = rng.randint(1, 20_000)
            chunks.append(data[at : at + n])
            at += n
        assert b"".join(zs.compress(chunks)) == whole
    assert b"".join(zs.decompress(whole[i : i + 7] for i in range(0, len(whole), 7))) == data
    assert len(whole) <= len(data) + 64 + len(data) // 64


def test_damage_is_noticed():
    data = streams()["log"][:20_000]
    whole = frame(data)
    for cut in (0, 1, 5, len(whole) // 2, len(whole) - 1):
        with pytest.raises(zs.CorruptStream):
            list(zs.decompress([whole[:cut]]))
    with pytest.raises(zs.CorruptStream):
        list(zs.decompress([whole, b"more"]))
    rng = random.Random(3)
    for _ in range(60):
        at = rng.randrange(len(whole))
        bad = whole[:at] + bytes([whole[at] ^ 1 << rng.randrange(8)]) + whole[at + 1 :]
        with pytest.raises(zs.CorruptStream):
            list(zs.decompress([bad]))


def test_output_comes_before_the_end():
    out, seen = 0, 0
    source = iter([b"line %d of the log\n" % i * 40 for i in range(2000)])

    def counted():
        nonlocal seen
        for c in source:
            seen += len(c)
            yield c

    early = None
    for piece in zs.compress(counted()):
        out += len(piece)
        if early is None and seen > 300_000:
            early = out
    assert early and early >= 0.2 * out * 300_000 / seen


def test_records_take_less_than_order_0_coding():
    data = streams()["log"]
    counts = {b: data.count(bytes([b])) for b in set(data)}
    v1 = sum(counts[b] * n for b, n in zs.code_lengths(counts).items()) / 8
    assert len(frame(data)) <= 0.52 * v1


def test_code_lengths_are_a_full_code_and_short():
    rng = random.Random(4)
    for _ in range(50):
        counts = {i: int(1.6**i) + rng.randrange(3) + 1 for i in range(rng.randint(2, 40))}
        lengths = zs.code_lengths(counts)
        assert max(lengths.values()) <= zs.LONGEST and sum(2.0**-n for n in lengths.values()) == 1
    assert zs.code_lengths({7: 3}) == {7: 1} and zs.code_lengths({}) == {}


def test_column_functions(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, b"abc" * 100), (2, b""), (3, None)], "id int, raw binary")
    back = rows.select("raw", zs.decompress_column(zs.compress_column(F.col("raw"))).alias("back"))
    assert all(r.raw == r.back for r in back.collect())
    assert zlib.crc32(b"") == 0


def test_counting_bytes_holds_a_slice(monkeypatch):
    """A batch of 64 MB is counted within a few slices of memory; keys beyond the limit are told early."""
    import tracemalloc

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["x", None] * 32), "__bytes": pa.array([b"ab" * (1 << 19)] * 64, pa.binary())})
    tracemalloc.start()
    found = list(zs.count_bytes([batch], "lang"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * zs.SLICE
    assert sorted(tuple(r.values()) for b in found for r in b.to_pylist() if r["lang"]) == [("x", 97, 1 << 24), ("x", 98, 1 << 24)]
    monkeypatch.setattr(zs, "KEYS", 2)
    batch = pa.RecordBatch.from_pydict({"k": pa.array([1, 2, 3, 1]), "__bytes": pa.array([b"a", b"", b"bb", b"a"], pa.binary())})
    assert [b.to_pylist() for b in zs.count_bytes([batch], "k")] == [[{"k": 1, "byte": 97, "n": 1}], [{"k": 3, "byte": 98, "n": 2}, {"k": 1, "byte": 97, "n": 1}]]


def test_a_null_key_and_long_texts_are_counted(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None, "aab"), ("x", "b"), ("x", None), (None, "")], "lang string, text string")
    assert {tuple(r) for r in zs.byte_histogram(rows, "text", "lang").collect()} == {(None, 97, 2), (None, 98, 1), ("x", 98, 1)}
    assert {tuple(r) for r in zs.huffman_sizes(zs.byte_histogram(rows, "text", "lang"), "lang").collect()} == {(None, 3, 1), ("x", 1, 1)}
    long = spark.range(1).select(F.expr("repeat(decode(unhex('C3A941'), 'UTF-8'), 900000)").alias("text"))
    assert {tuple(r) for r in zs.context_counts(long, "text").collect()} == {(0, 0xC3, 16), (1, 0xC3, 16 * 899_999), (3, 0xA9, 16 * 900_000), (2, 0x41, 16 * 900_000)}

"""Extendible hashing: shards fit, are as shallow as can be, and hold every row."""

import hashlib
from collections import defaultdict

import pytest

from tessera.llm.sharding import assign_shards, op9_sharding, write_shards
from tessera.llm.common import shared_folder


def bits(doc_id):
    return int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:15], 16)


def plain(rows, limit):
    """Row -> (depth, prefix) by splitting one bit at a time."""
    out, todo = {}, [(0, 0, list(range(len(rows))))]
    while todo:
        depth, prefix, mine = todo.pop()
        if sum(len((rows[i][1] or "").encode()) for i in mine) <= limit or depth == 60:
            out |= {i: (depth, prefix) for i in mine}
            continue
        for bit in (0, 1):
            part = [i for i in mine if bits(rows[i][0]) >> (59 - depth) & 1 == bit]
            if part:
                todo.append((depth + 1, prefix * 2 + bit, part))
    return out


@pytest.mark.parametrize("limit,step", [(10_000, 10), (700, 3), (150, 10), (10**9, 10)])
def test_matches_splitting_by_hand(spark, limit, step):
    rows = [(i, "é" * (i * 7 % 60)) for i in range(300)] + [(1000, None), (1001, ""), (None, "no id")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, shard string").repartition(4)
    got = {r.doc_id: r for r in assign_shards(docs, limit, step=step).collect()}
    want = plain(rows, limit)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(rows):
        assert (got[d].depth, got[d].prefix) == want[i] and got[d].bytes == len((t or "").encode())
    size = defaultdict(int)
    for r in got.values():
        size[r.shard] += r.bytes
    assert all(size[r.shard] == r.shard_bytes <= limit and not r.oversize for r in got.values())


def test_a_hot_key_gets_pages(spark):
    rows = [(7, "x" * 50) for _ in range(200)] + [(7, "y" * 900)] + [(i, "z" * 20) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = assign_shards(docs, 500).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.bytes
    assert len(got) == len(rows) and all(size[r.shard] == r.shard_bytes for r in got)
    assert {r.bytes for r in got if r.oversize} == {900} and all(r.shard_bytes <= 500 for r in got if not r.oversize)


def test_written_shards_hold_every_row(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('a', CAST(id AS INT)) AS text")
    folder = f"{shared_folder(spark)}/shards"
    write_shards(docs, assign_shards(docs, 2000), folder)
    back = spark.read.parquet(folder)
    assert back.count() == 200 and back.groupBy("shard").agg({"text": "count"}).count() > 5


def test_written_shards_keep_columns_of_any_name(spark):
    docs = spark.range(60).selectExpr("id AS doc_id", "repeat('a', CAST(id AS INT)) AS text", "'mine' AS shard", "1 AS id")
    folder = f"{shared_folder(spark)}/shards"
    write_shards(docs, assign_shards(docs, 500), folder)
    back = spark.read.parquet(folder)
    assert {r.shard for r in back.collect()} == {"mine"} and len(back.columns) == 5


def test_the_query_splits_to_several_depths(spark):
    got = op9_sharding(spark, "/root/testdata/sf0.01").select("depth", "shard", "oversize").distinct().collect()
    assert len({r.depth for r in got}) > 1 and len(got) > 8 and not any(r.oversize for r in got)


def test_page_names_do_not_change(spark):
    rows = [(7, "x" * 50) for _ in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = assign_shards(docs, 500)
    assert sorted(r.shard for r in found.collect()) == sorted(r.shard for r in found.collect())


def test_empty_and_bad_limit(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert assign_shards(docs, 10).collect() == []
    with pytest.raises(ValueError):
        assign_shards(docs, 0)

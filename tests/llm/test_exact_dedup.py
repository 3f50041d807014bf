"""Exact dedup: against a dictionary of texts, with a digest that collides, and on odd inputs."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm.exact_dedup import DigestIndex, drop_copies, exact_dedup, op2_exact_dedup

SCHEMA = "doc_id long, text string, digest string, kept boolean"


def rows_of(spark):
    texts = ["a", "b", "A", "a ", "", None, "ö", "x" * 5000]
    rows = [(i, texts[i * i % 7 if i % 5 else 0], "clash", False) for i in range(60)] + [(60, "x" * 5000, None, None), (60, "x" * 5000, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


def expected(rows, keep=max):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    return {(d, keep(ids), len(ids), d == keep(ids)) for ids in groups.values() for d in ids}


def test_largest_id_stays(spark):
    rows, docs = rows_of(spark)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()]
    assert set(got) == expected(rows) and len(got) == len(set(got))


def test_smallest_id_stays(spark):
    rows, docs = rows_of(spark)
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, keep="min").collect()} == expected(rows, min)


def test_colliding_digests_are_told_apart_by_the_texts(spark):
    rows, docs = rows_of(spark)
    weak = lambda text: F.unhex(F.substring(F.hex(F.unhex(F.sha2(text, 256))), 1, 1))  # four bits
    got = exact_dedup(docs, digest=weak).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == expected(rows)
    assert any(r.collided for r in got)


def test_dropping_keeps_all_columns_and_one_row(spark):
    rows, docs = rows_of(spark)
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({k for _, k, _, _ in expected(rows)})


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (1, "a"), (None, "c"), (None, "d"), (3, "d")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in drop_copies(docs).collect()), key=repr) == sorted([(1, "a"), (2, "b"), (None, "c"), (3, "d")], key=repr)


def test_any_number_of_batches(spark):
    rows, docs = rows_of(spark)
    for n in (1, 3, 5):
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, batches=n).collect()} == expected(rows)


def test_a_batch_meets_older_runs_through_their_filters_only(spark):
    index = DigestIndex(spark, keep="min")
    old = spark.range(20_000).selectExpr("id AS doc_id", "concat('old ', id) AS text")
    assert index.add(old).count() == 0
    new = spark.range(20_000, 24_000).selectExpr("id AS doc_id", "IF(id < 20050, concat('old ', id - 20000), concat('new ', id)) AS text")
    digests = new.select(index.digest(F.col("text")).alias("digest"))
    run = index.runs()[0]
    asked = run.may_hold(digests).count()
    assert 50 <= asked < 50 + 4_000 * 0.05  # all hits pass, of the others few
    hits = index.add(new)
    assert sorted((r.keep_id, r.group_size) for r in hits.collect()) == [(i, 1) for i in range(50)]
    assert [len(level) for level in index.levels] == [0, 1]  # two runs of a level became one of the next
    again = index.add(spark.createDataFrame([(7, "old 3"), (90_000, "fresh")], "doc_id long, text string"))
    assert [(r.keep_id, r.group_size) for r in again.collect()] == [(3, 2)]
    assert [len(level) for level in index.levels] == [1, 1]  # the large run was not merged again
    assert index.entries().count() == 20_000 + 3_950 + 1


def test_columns_with_the_names_of_helpers(spark):
    docs = spark.createDataFrame([(1, "a", "x", 1, 2), (1, "b", "y", 3, 4), (1, "a", "x", 1, 2), (2, "b", "z", 5, 6)], "doc_id long, text string, __mark string, __kept long, __id long")
    for name in ("slot", "digest", "count", "mark", "kept"):
        docs = docs.withColumn(name, F.lit("own"))
    left = drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text, r["__mark"], r["__kept"], r["__id"], r.kept) for r in left.collect()) == [(1, "a", "x", 1, 2, "own"), (2, "b", "z", 5, 6, "own")]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(docs).collect() == [] and drop_copies(docs).collect() == []


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = op2_exact_dedup(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id: r.text_sha256 for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in texts.items()}

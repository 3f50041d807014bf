"""The quality classifier: held-out accuracy, the non-negative risk, and odd inputs."""

import zlib

import numpy as np
import pytest

from tessera.llm import quality as q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in q.op6_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(rows[d], y) for d, y in labels.items() if d in rows and rows[d].held_out]
    assert np.mean([r.predicted == y for r, y in held]) >= 0.95
    good, bad = [r.score for r, y in held if y], [r.score for r, y in held if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.97
    assert np.mean([r.predicted for r, y in held if y]) >= 0.98


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "IF(crc32(CAST(doc_id AS STRING)) % 5 = 0, 1 - quality, quality) AS quality", "toxic")
    assert np.array_equal(q.train(docs, labels).weights, q.train(docs, turned).weights)


def test_risk_is_that_of_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (3000, 3)), rng.normal([4, 0, 0], 1, (1000, 3))
    model = q.fit(good[:1500], np.vstack([good[1500:], bad[:500]]), prior=0.75)
    # four deviations apart: the best rule on the first number alone is right in about 0.97 of the cases
    right = [*(model.score(good[:500]) >= 0.5), *(model.score(bad[500:]) < 0.5)]
    assert np.mean(right) >= 0.9
    # all positives and nothing else: the plain unlabelled risk could fall below zero, the kept one does not
    alone = q.fit(good[:200], good[200:400], prior=0.75)
    assert np.isfinite(alone.weights).all() and alone.score(good[400:]).mean() > 0.5


def test_no_positives_give_the_prior(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = q.train(docs, labels)
    assert model.weights is None and docs.select(q.score_column(model)).distinct().count() == 1
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.train(docs, empty).prior == 0.5
    assert q.keep_good(docs.limit(0), empty).collect() == []


@pytest.mark.parametrize("text", [None, "", " \n", "x", "É", "a\ud800".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "word " * 60_000, "!!!", "\x00\x01", "a b\n" * 3])
def test_features_are_finite(text):
    x = q.features(text)
    assert x.shape == (q.N_FEATURES,) and np.isfinite(x).all()


def test_stage_keeps_columns_and_good_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("n_chars", "score")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    left = q.keep_good(docs, labels)
    kept = {r.doc_id for r in left.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert left.columns == docs.columns and len(good - kept) <= 0.02 * len(good)

"""The pipeline against its stages done by hand."""

import random

import numpy as np

import corpus_pipeline
from tessera.llm import bpe
from tessera.llm import decontaminate as dc
from tessera.llm import quality as q
from tessera.llm.simhash import shingle_set, word_fingerprints

SF = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = q.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(q.features(r.text)[None])[0] >= q.THRESHOLD]
    last = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        last[r.text] = r
    rows = sorted(last.values(), key=lambda r: r.doc_id)
    prints = [word_fingerprints(r.text).view(np.uint64).tolist() for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def link(test):
        for i in range(len(rows)):
            for j in range(i):
                if test(i, j):
                    a, b = sorted((find(i), find(j)))
                    root[b] = a

    link(lambda i, j: any((x ^ y).bit_count() <= 3 for x, y in zip(prints[i], prints[j])))
    group, root = [find(i) for i in range(len(rows))], list(range(len(rows)))
    sets = [set(shingle_set(r.text).tolist()) for r in rows]
    link(lambda i, j: group[i] == group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    items = [(r.item_id, dc.split_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {h[0] for h in dc.ItemIndex(items).search([dc.split_words(r.text) for r in rows])}
    rows = [r for i, r in enumerate(rows) if i not in hit]
    coder = bpe.tokenizer(bpe.default_path())
    want = {r.doc_id: len(coder.encode(r.text)) for r in rows}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()


def test_near_copies_at_a_similarity_of_0_8_over_five_words(spark):
    """Of texts with some words changed, which still share 0.8 of their five-word shingles, over nine in ten go; no other does."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 8))) for _ in range(3000)]
    word = lambda: vocabulary[min(int(rng.expovariate(1 / 300)), 2999)]
    rows, near = [], set()
    for i in range(150):
        base = [word() for _ in range(rng.randint(60, 500))]
        rows.append((2 * i, " ".join(base), "en", "s", 0))
        shingles = {tuple(base[j : j + 5]) for j in range(len(base) - 4)}
        copy = list(base)
        while True:
            more = list(copy)
            more[rng.randrange(len(more))] = word()
            other = {tuple(more[j : j + 5]) for j in range(len(more) - 4)}
            if len(shingles & other) / len(shingles | other) < 0.8:
                break
            copy = more
        rows.append((2 * i + 1, " ".join(copy), "en", "s", 0))
        near.add(2 * i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, SF).collect()}
    assert left >= {d for d, *_ in rows} - near
    assert len(near - left) >= 0.9 * len(near)

"""Ranked search against the definition, on odd tables, in blocks and windows of any size."""

import math
import random
import re
from collections import Counter

import pytest

from tessera.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n long, terms string, tfs int, item long, score double"


def cut(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, depth=10):
    cuts = [(d[0], Counter(cut(d[1]))) for d in docs]
    cuts = [(i, c, c.total()) for i, c in cuts if c]
    n_docs, n_terms, df = len(cuts), sum(x[2] for x in cuts), Counter(t for _, c, _ in cuts for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, Counter()).update(cut(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c, n in cuts:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:depth], 1)]
    return out


def tables():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "straße", "A1", "x_y", "don't", "数据", "Ünder-score"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(500 + i, "w1 w2 w3 same") for i in range(25)] + [(510, "w1 w2 w3 same"), (510, "w1 w2 w3 same"), (510, "w1")]
    docs += [(600, None), (601, ""), (602, " .,-"), (None, "w1 w2 w3 same"), (None, "only null"), (603, "long " * 50_000 + "w5"), (-4, "w1 w2 w3 same")]
    items = [(1, "w1 w2 w3 same"), (2, "W7 w7 É straße"), (3, "nothing here matches-not"), (4, None), (5, ""), (6, "数据 A1 x"), (6, "long w39"), (None, "only w5"), (7, " ".join(words))]
    return [(*d, 1, "clash", 2, 3, 0.5) for d in docs], items


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("block, most_terms, parts", [(ranked.BLOCK, ranked.TERMS, 6), (2, 10_000, 1), (100, 8, 13)])
def test_definition(spark, block, most_terms, parts):
    docs, items = tables()
    frames = spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, "item_id long, text string")
    assert got(ranked.search(*frames, block=block, most_terms=most_terms)) == sorted(map(repr, expected(docs, items)))


def test_windows_of_any_size(monkeypatch):
    docs, items = tables()
    docs = sorted(((d[0] if d[0] is not None else ranked.LAST, Counter(ranked.terms(d[1]))) for d in docs), key=lambda d: d[0])
    docs = [d for d in docs if d[1]]
    vocabulary = {t: k for k, t in enumerate(sorted({t for i in items for t in ranked.terms(i[1])}))}
    import numpy as np

    ready = [(np.array([vocabulary[t] for t in c]), np.array(list(c.values()))) for c in (Counter(ranked.terms(i[1])) for i in items)]
    ready = [(x.astype(int), y.astype(int)) for x, y in ready]
    weights, answers = np.arange(1, len(vocabulary) + 1), []
    for size in (1, 7, 64, ranked.WINDOW):
        segment = ranked.Segment(ready, weights, len(docs), sum(c.total() for _, c in docs), 10)
        rows = [(i, c.total(), np.array([vocabulary[t] for t in c if t in vocabulary], int), np.array([k for t, k in c.items() if t in vocabulary], int)) for i, c in docs]
        rows = [r for r in rows if len(r[2])]
        for at in range(0, len(rows), size):
            segment.add(rows[at : at + size])
        answers.append([sorted(h) for h in segment.heaps])
        assert not segment.sums.any() and not segment.hit.any()
    assert all(a == answers[0] for a in answers) and any(answers[0])


def test_empty_tables(spark):
    docs, items = tables()
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], DOCS)
    asked, nothing = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    for d, i in ((none, asked), (some, nothing), (none, nothing), (some.where("doc_id = 600"), asked)):
        assert got(ranked.search(d, i)) == []


def test_other_column_names_and_depth(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, DOCS).selectExpr("doc_id AS id", "text AS body", "n AS item_id")
    i = spark.createDataFrame([(str(a), b) for a, b in items], "name string, body string").withColumnRenamed("body", "text")
    found = ranked.search(d.withColumnRenamed("body", "text"), i, "id", "text", "name", depth=3).collect()
    want = expected(docs, [(str(a), b) for a, b in items], 3)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))

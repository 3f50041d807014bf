"""Katz scoring against a model written down from its definition."""

import functools
import math
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import katz


def brute(rows, fold_by=10):
    """doc_id -> (held_out, n_tokens, n_known, N, base_score, score)."""
    texts = [(d, (t or "").encode().lower().split() + [b"\n"]) for d, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % fold_by == 0 for d, _ in texts]
    train = [t for (_, t), h in zip(texts, held) if not h]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip([b"\n"] + t, t))
    n, v = sum(uni.values()), len(uni)
    n_of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    lu, lb = katz.discounts(n_of(uni)), katz.discounts(n_of(bi))
    d = lambda level, r: level.factor[min(r, katz.K + 1)] * r
    freed = sum(r - d(lu, r) for r in uni.values())
    total = n if freed > 1e-9 else n + 1
    unknown = freed / n if freed > 1e-9 else 1 / (n + 1)
    p1 = lambda w: d(lu, uni[w]) / total if w in uni else unknown
    followers = defaultdict(list)
    for (a, b), r in bi.items():
        followers[a].append((b, r))
    mass = {}
    for a, seen in followers.items():
        div = uni[a] if any(r <= katz.K for _, r in seen) else uni[a] + 1
        alpha = (1 - sum(d(lb, r) for _, r in seen) / div) / (1 - sum(p1(b) for b, _ in seen))
        mass[a] = (div, alpha)
        everything = sum(d(lb, r) / div for _, r in seen) + alpha * (unknown + sum(p1(w) for w in uni if (a, w) not in bi))
        assert math.isclose(everything, 1, abs_tol=1e-9)
    out = []
    for (i, t), h in zip(texts, held):
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        s = 0.0
        for a, b in zip([b"\n"] + t, t):
            if (a, b) in bi:
                s += math.log10(d(lb, bi[a, b]) / mass[a][0])
            else:
                s += math.log10((mass[a][1] if a in mass else 1) * p1(b))
        out.append((i, h, len(t), sum(w in uni for w in t), n, base, s))
    return out


def brute_order(rows, order, others=(), fold_by=10):
    """As `brute`, for any order and in a recursion over contexts; scores of `rows` and then of `others`."""
    texts = [(d, (t or "").encode().lower().split() + [b"\n"]) for d, t in [*rows, *others]]
    held = [d is not None and zlib.crc32(str(d).encode()) % fold_by == 0 for d, _ in texts]
    train = [t for (_, t), h in zip(texts[: len(rows)], held) if not h]
    grams = lambda t, k: [tuple(([b"\n"] + t)[i : i + k]) for i in range(max(len(t) + 2 - k, 0))] if k > 1 else [(w,) for w in t]
    counts = {k: Counter(g for t in train for g in grams(t, k)) for k in range(1, order + 1)}
    levels = {k: katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]) for k, c in counts.items()}
    d = lambda k, r: levels[k].factor[min(r, katz.K + 1)] * r
    n, v = sum(counts[1].values()), len(counts[1])
    freed = sum(r - d(1, r) for r in counts[1].values())
    followers = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, r in c.items():
            followers[k][g[:-1]].append((g[-1], r))

    @functools.cache
    def left(h):
        k, seen = len(h) + 1, followers[len(h) + 1][h]
        div = sum(r for _, r in seen) + all(r > katz.K for _, r in seen)
        return div, (1 - sum(d(k, r) for _, r in seen) / div) / (1 - sum(p(h[1:], x) for x, _ in seen))

    @functools.cache
    def p(h, w):
        if not h:
            r = counts[1][(w,)]
            return d(1, r) / (n if freed > 1e-9 else n + 1) if r else freed / n if freed > 1e-9 else 1 / (n + 1)
        if h not in followers[len(h) + 1]:
            return p(h[1:], w)
        div, alpha = left(h)
        r = counts[len(h) + 1][(*h, w)]
        return d(len(h) + 1, r) / div if r else alpha * p(h[1:], w)

    for h in list(followers[order])[:5]:  # the probabilities of a context sum to one
        assert math.isclose(sum(p(h, w) for (w,) in counts[1]) + p(h, None), 1, abs_tol=1e-9)
    out = []
    for (i, t), h in zip(texts, held):
        padded = [b"\n"] + t
        s = sum(math.log10(p(tuple(padded[max(0, j + 2 - order) : j + 1]), w)) for j, w in enumerate(t))
        base = sum(math.log10((counts[1][(w,)] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((i, h, len(t), sum((w,) in counts[1] for w in t), n, base, s))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("order,block,bucket", [(2, 150, 60), (3, 1_000_000, 1_000_000), (3, 150, 60), (4, 100, 200)])
def test_any_order_and_other_texts(spark, order, block, bucket):
    words = "the of and a to Ab x1 q-q .".split(" ")
    rows = [(i, " ".join(words[(i * k * 7 + k * k) % (3 + i % len(words)) % len(words)] for k in range(i % 37))) for i in range(60)]
    rows += [(90, None), (91, ""), (None, "the of"), (93, "only here " * 40)]
    others = [(200 + i, " ".join(words[(i + k * k) % len(words)] if k % 5 else f"new{k % 3}" for k in range(i % 23))) for i in range(40)] + [(7, None)]
    docs, more = (spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (rows, others))
    model = katz.KatzModel(order, block=block, bucket=bucket)
    want = brute_order(rows, order, others)
    same(model.fit_score(docs).collect(), want[: len(rows)])
    same(model.score(more).collect(), want[len(rows) :])
    if order == 2:
        same(brute(rows), want[: len(rows)])


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(katz.op8_katz(spark, sf).collect(), brute_order(rows, 2))


@pytest.mark.parametrize("block,bucket", [(1_000_000, 1_000_000), (150, 60)])
def test_matches_the_definition(spark, block, bucket):
    words = "the of and a to Ab ÉÉ x1 y\x0bz q-q . 日本".split(" ")
    rows = [(i, " ".join(words[(i * k * 7 + k * k) % (3 + i % len(words)) % len(words)] for k in range(i % 37))) for i in range(90)]
    rows += [(90, None), (91, ""), (91, ""), (None, "the of"), (93, "only here " * 40), (94, "\t A\na ")]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, score string").repartition(3)
    got = sorted((tuple(r) for r in katz.score(docs, block=block, bucket=bucket).collect()), key=repr)
    want = sorted(brute(rows), key=repr)
    assert len(got) == len(want)
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_empty_and_no_training_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score(docs).collect() == []
    held = next(i for i in range(100) if katz.is_held_out(i, 10))
    row = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_packing_round_trips():
    import numpy as np

    for x in (np.array([], "<u4"), np.arange(5, dtype="<u4"), np.array([1.5, -2.0, math.pi])):
        assert (katz.unpack(katz.pack(x), x.dtype) == x).all()

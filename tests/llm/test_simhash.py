"""SimHash fingerprints and components against their definition over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.common import shared_folder

LOW = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", ["", None, "one", "Two WORDS", "a b c", "A\u000bB\u001cc d É\u0085x É", "to be or not to be or not to be " * 50, " \n", "ẞ İ ſ a A a A"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(seed, families, size, spread):
    rng, out = random.Random(seed), set()
    for _ in range(families):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randint(0, spread)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("small,block,seed", [(64, 2048, 1), (2, 5, 2), (4, 3, 3)])
def test_links_connect_what_all_pairs_connect(spark, small, block, seed):
    fps = clusters(seed, 6, 40, 4) + clusters(seed + 9, 40, 2, 5)
    fps = sorted(set(fps) | {0, 7, (1 << 64) - 1})
    folder = shared_folder(spark)
    rows = spark.createDataFrame([(as_long(x),) for x in fps], "fp long")
    links = simhash.links_of(rows, folder, small, block)
    assert links.where(F.expr("bit_count(a ^ b) > 3")).count() == 0
    found = {r.node: r.root for r in simhash.components(links, folder).collect()}
    want = plain_components(fps)
    groups = {}
    for x, w in zip(fps, want):
        groups.setdefault(w, []).append(as_long(x))
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_every_link_of_a_ball(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    ball = [base] + [base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3) for _ in range(60)]
    folder = shared_folder(spark)
    links = simhash.links_of(spark.createDataFrame([(as_long(x),) for x in set(ball)], "fp long"), folder)
    reached = {r.root for r in simhash.components(links, folder).collect()}
    assert len(reached) == 1


def test_forest_is_a_forest():
    fps = np.array([as_long(x) for x in clusters(4, 3, 30, 3)])
    links = simhash.forest(fps)
    assert len(links) < len(fps) and all((a ^ b).bit_count() <= 3 if a ^ b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links)


def test_near_dedup_of_documents(spark):
    texts = ["the cat sat on the mat today " * 30, "the cat sat on the mat today " * 30, None, "", " ", "one two", "ONE two", "other words here entirely"]
    rows = [(i + 10, t, "x") for i, t in enumerate(texts)] + [(5, "one TWO", "y"), (5, "one TWO", "y"), (None, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_dedup(docs).collect()}
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    group = plain_components(fps)
    want = {(d, min(e for (e, *_), h in zip(rows, group) if h == g and e is not None)) for (d, *_), g in zip(rows, group)}
    assert got == want
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted({c for _, c in want})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_dedup(docs).collect() == [] and simhash.drop_near_copies(docs).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    group = plain_components(fps)
    want = {(r.doc_id, f"{f:016x}", min(x.doc_id for x, h in zip(rows, group) if h == g)) for r, f, g in zip(rows, fps, group)}
    assert {tuple(r) for r in simhash.op3_simhash(spark, sf).collect()} == want


def plain_word_fingerprints(text, rounds):
    counts = {}
    for w in (text or "").translate(LOW).split():
        counts[w] = counts.get(w, 0) + 1
    out = []
    for t in range(rounds):
        odd, ones = int(simhash._ROUND[t]), [0.0] * 64
        for w, c in counts.items():
            h = xxhash.xxh64_intdigest(w.encode(), 42) * odd % (1 << 64)
            h = (h ^ h >> 32) * odd % (1 << 64)
            h ^= h >> 29
            for b in range(64):
                ones[b] += (1 + np.log2(c)) * (h >> b & 1)
        out.append(sum(1 << b for b in range(64) if 2 * ones[b] > sum(1 + np.log2(c) for c in counts.values())))
    return out


@pytest.mark.parametrize("text", ["", None, "one", "a A a b", "to be or not to be " * 30 + "that is the question"])
def test_word_fingerprints(text):
    assert simhash.word_fingerprints(text, 3).view(np.uint64).tolist() == plain_word_fingerprints(text, 3)


def plain_similarity(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").translate(LOW).split()] for i in range(max(1, len(w) - 4) if w else 0)}
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def test_near_copies_are_the_similar_texts_of_candidate_groups(spark):
    rng = random.Random(4)
    texts = [None, "", "", "x", "X"]
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        for _ in range(rng.randint(1, 12)):
            more = list(base)
            for _ in range(rng.randint(0, 3)):
                more[rng.randrange(len(more))] = f"w{rng.randrange(300)}"
            texts.append(" ".join(more))
    rows = [(i, t, "own", 1) for i, t in enumerate(texts)] + [(3, "y z", "own", 1), (None, texts[9], "own", 1), (None, "nobody else", "own", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__mark` string, node long").repartition(4)
    prints, texts_of = [plain_word_fingerprints(t, 2) for _, t, *_ in rows], [t for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if any((x ^ y).bit_count() <= 3 for x, y in zip(prints[i], prints[j])):
                root[find(i)] = find(j)
    candidates, root = [find(i) for i in range(len(rows))], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if candidates[i] == candidates[j] and plain_similarity(texts_of[i], texts_of[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, *_) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    want = sorted((repr(d), repr(min((x for x in groups[find(i)] if x is not None), default=None))) for i, (d, *_) in enumerate(rows))
    assert sorted((repr(r.doc_id), repr(r.component_id)) for r in simhash.near_copies(docs, rounds=2).collect()) == want
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns and {r["__mark"] for r in left.collect()} == {"own"}
    assert simhash.near_copies(docs.limit(0)).collect() == [] and simhash.drop_near_copies(docs.limit(0)).collect() == []


def test_texts_of_the_same_words_are_no_copies(spark):
    """Long random texts over few words, the same words in another order, and lines alike but for numbers: close fingerprints, other texts."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=6000))) for i in range(6)]
    rows += [(10, "the cat sat on the mat"), (11, "mat the on sat cat the")]
    rows += [(20 + i, " ".join(f"invoice {rng.randrange(10**6)} was paid on time in full by the customer named below" for _ in range(12))) for i in range(30)]
    rows += [(90, rows[0][1] + " more"), (91, "more " + rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r[0] for r in rows} - {90, 91}
    assert all(plain_similarity(a[1], b[1]) < 0.8 for a in rows[:-2] for b in rows[:-2] if a[0] < b[0])
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == want


@pytest.mark.parametrize("block", [simhash.SHINGLES, 900, 200])
def test_blocks_of_a_group_lose_no_link(spark, tmp_path, block):
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(50)]
    texts = []
    for _ in range(70):
        more = list(base)
        for _ in range(rng.randint(0, 4)):
            more[rng.randrange(50)] = f"w{rng.randrange(900)}"
        texts.append(" ".join(more))
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = docs.selectExpr("0L AS root", "doc_id AS node", "doc_id AS first_id", "xxhash64(text) AS hash", "50L AS n_words")
    links = {(r.a, r.b) for r in simhash.verified_links(docs, members, f"file://{tmp_path}", block=block).collect()}
    assert all(plain_similarity(texts[a], texts[b]) >= 0.8 for a, b in links)
    root = list(range(len(texts)))

    def name(pairs):
        root[:] = range(len(texts))
        for a, b in pairs:
            a, b = root[a], root[b]
            root[:] = [min(a, b) if x in (a, b) else x for x in root]
        return list(root)

    assert name(links) == name([(a, b) for a in range(len(texts)) for b in range(a) if plain_similarity(texts[a], texts[b]) >= 0.8])
    assert len(set(root)) > 1


def test_whole_table_against_all_pairs(spark):
    """Precision 1 and recall 0.9 or more of pairs that are in one component, over every text of a table."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    holders, sets = {}, {d: set(simhash.shingle_set(t).tolist()) for d, t in texts.items()}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    true = []
    for d, s in sets.items():
        shared = {}
        for x in s:
            for e in holders[x]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        near = [e for e, n in shared.items() if 5 * n >= 4 * (len(s) + len(sets[e]) - n)]
        true += [(d, e) for e in near]
        for e in near:
            root[find(d)] = find(e)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    groups = {}
    for d in texts:
        groups.setdefault(got[d], set()).add(find(d))
    assert all(len(g) == 1 for g in groups.values())
    different = [(a, b) for a, b in true if texts[a] != texts[b]]
    assert len(different) > 30 and sum(got[a] == got[b] for a, b in different) >= 0.9 * len(different)

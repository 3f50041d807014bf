"""Decontamination: edit distance, recall of the LSH against all windows, planted passages, odd inputs."""

import pickle
import random

import pytest

from tessera.llm import decontaminate as dc


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(90))] for _ in range(2))
        most = rng.randrange(100)
        assert dc.edits(a, b, most) == min(plain_edits(a, b), most + 1)


@pytest.mark.parametrize("places", ["anywhere", "front", "middle", "end"])
@pytest.mark.parametrize("n,k", [(8, 1), (9, 1), (10, 2), (11, 2), (12, 2), (20, 4), (40, 8), (60, 12)])
def test_target_recall(n, k, places):
    assert dc.expected_recall(n, k, places=places) >= 0.99


@pytest.mark.parametrize("n,k", [(8, 1), (20, 4), (40, 8), (60, 12)])
def test_finds_edits_at_every_place(n, k):
    rng = random.Random(n)
    for trial in range(40):
        item = [b"w%d" % rng.randrange(10_000) for _ in range(n)]
        around = [b"x%d" % rng.randrange(10_000) for _ in range(n)]
        spots = [range(k), range((n - k) // 2, (n - k) // 2 + k), range(n - k, n), rng.sample(range(n // 2), k), rng.sample(range(n), k)]
        texts = [around + [b"v" if p in spot else w for p, w in enumerate(item)] + around for spot in spots]
        found = dc.ItemIndex([(0, item)], seed=trial).search(texts)
        assert [(t, d) for t, _, _, _, d in found] == [(t, k) for t in range(len(spots))]


def best_span(item, text):
    most = int(dc.SHARE * len(item))
    spans = range(max(len(item) - most, 1), len(item) + most + 1)
    found = [plain_edits(item, text[s : s + m]) for s in range(len(text)) for m in spans if s + m <= len(text)]
    return min(found) if found and min(found) <= most else None


@pytest.mark.parametrize("n", [8, 12, 20])
def test_added_missing_and_cut_off_words(n):
    rng, k, found = random.Random(n), n // 5, 0
    word = lambda kind, of=10_000: b"%s%d" % (kind, rng.randrange(of))
    items = [[word(b"w", 10_000 if i % 2 else 6) for _ in range(n)] for i in range(4)]
    texts = []
    for i, item in enumerate(items):
        more, less, both = list(item), list(item), list(item)
        for _ in range(k):
            more.insert(rng.randrange(1, len(more)), word(b"v"))
            del less[rng.randrange(len(less))]
        del both[n // 2]
        both.insert(rng.randrange(1, n - 1), word(b"v"))
        before, after = [word(b"x") for _ in range(rng.randrange(5))], [word(b"x") for _ in range(rng.randrange(5))]
        texts += [before + t + after for t in (more, less, both, item[: n // 2] + [word(b"v") for _ in range(k + 1)] + item[n // 2 :])]
        texts += [item[1:], item[:-1], item[k:], item[: n - k], item[k + 1 :], before + item[: n - k], item[k:] + after]
    got = {(t, i): d for t, i, _, _, d in dc.ItemIndex(list(enumerate(items))).search(texts)}
    want = {(t, i): d for t, text in enumerate(texts) for i, item in enumerate(items) if (d := best_span(item, text)) is not None}
    assert got == want and len(want) >= 8 * len(items)
    # the start is that of a run as close as is said
    for t, i, start, m, d in dc.ItemIndex(list(enumerate(items))).search(texts):
        assert d in [plain_edits(items[i], texts[t][start : start + m + x]) for x in range(-d, d + 1)]


def test_document_shorter_than_its_item(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, item.split(" ", 1)[1]), (2, item.rsplit(" ", 9)[0])], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in dc.contaminated(docs, b).collect()] == [(1, 7, 0, 40, 1, 0.975)]
    assert [r.doc_id for r in dc.drop_contaminated(docs, b).collect()] == [2]


def test_null_ids_and_short_items(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "before " + item), (2, "so, what IS this?"), (3, "what is that"), (4, "and"), (5, "this what is")], "doc_id long, text string")
    b = spark.createDataFrame([(None, item), ((1 << 60) + 1, item), (4, "what is this"), (5, ""), (None, "and"), (6, "seven words of which one may differ")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word, r.edits) for r in dc.contaminated(docs, b).collect()}
    assert got == {(1, None, 1, 0), (1, (1 << 60) + 1, 1, 0), (2, 4, 1, 0), (4, None, 0, 0)}
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, b).collect()) == [3, 5]
    # one index at a time: the same with a block for each item
    assert {(r.doc_id, r.item_id, r.start_word, r.edits) for r in dc.contaminated(docs, b, block=1).collect()} == got
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, b, block=1).collect()) == [3, 5]


def test_a_very_long_item_takes_little_memory():
    rng = random.Random(2)
    items = [(i, [b"w%d" % rng.randrange(50_000) for _ in range(60)]) for i in range(2000)] + [(2000, [b"w%d" % rng.randrange(50_000) for _ in range(5000)])]
    index = dc.ItemIndex(items)
    assert len(pickle.dumps(index)) < 40 << 20
    text = [b"x"] * 50 + [w for i, w in enumerate(items[-1][1]) if i % 9] + [b"x"] * 50
    assert [(i, d) for _, i, _, _, d in index.search([text, [b"x"] * 9000])] == [(2000, 556)]


def test_words():
    assert dc.split_words("Don't STOP—now 3.5é") == [b"don", b"t", "stop—now".encode(), b"3", "5é".encode()]
    assert dc.split_words(None) == [] and dc.split_words(" .") == []


def brute(docs, items):
    out = set()
    for d, t in docs:
        words = dc.split_words(t)
        for i, s in items:
            item = dc.split_words(s)
            if item:
                most = int(dc.SHARE * len(item)) if len(item) >= dc.MIN_WORDS else 0
                found = [dc.edits(item, words[p : p + len(item)], most) for p in range(len(words) - len(item) + 1)]
                if found and min(found) <= most:
                    out.add((d, i, min(found)))
    return out


def passages(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(9, 50))) for i in range(30)] + [(30, "too short"), (31, None), (32, "same words here as the other item has them"), (33, "same words here as the other item has them")]
    docs = []
    for d in range(60):
        text = prose(rng.randint(0, 200)).split()
        i, s = items[d % 34]
        part = (s or "").split()
        for _ in range(int(len(part) * [0, 0, 0.1, 0.5][d % 4])):
            part[rng.randrange(len(part))] = word()
        at = rng.randint(0, len(text))
        docs.append((d, ", ".join(text[:at] + [w.upper() for w in part] + text[at:])))
    return docs + [(60, None), (61, ""), (62, "x " * 30_000 + (items[0][1])), (62, items[0][1]), (None, items[1][1])], items


def test_planted_passages(spark):
    docs, items = passages()
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.edits) for r in dc.contaminated(d, b).collect()}
    want = brute(docs, items)
    assert got <= want and {x[:2] for x in want if x[2] == 0} <= {x[:2] for x in got} and len(got) >= 0.95 * len(want)
    # the block size changes nothing for exact passages
    small = {(r.doc_id, r.item_id) for r in dc.contaminated(d, b, block=7).collect()}
    assert {x[:2] for x in want if x[2] == 0} <= small
    left = dc.drop_contaminated(d, b)
    assert left.columns == d.columns
    gone = {x[0] for x in want if x[2] == 0}
    kept = [r.doc_id for r in left.collect()]
    assert not gone & set(kept) and set(kept) >= {i for i, _ in docs} - {x[0] for x in want}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, none).collect() == [] and dc.drop_contaminated(docs, none).count() == 1
    assert dc.contaminated(docs.limit(0), items).collect() == [] and dc.contaminated(docs, items).count() == 1


def test_whole_table_finds_every_exact_passage(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, b" " + b" ".join(dc.split_words(r.text)) + b" ") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, dc.split_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, w in items if len(w) >= dc.MIN_WORDS and b" " + b" ".join(w) + b" " in t}
    got = {(r.doc_id, r.item_id): r.edits for r in dc.op4_decontaminate(spark, sf).collect()}
    assert want == {k for k, e in got.items() if e == 0} and want

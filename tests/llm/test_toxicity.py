"""The toxicity lexicon: held-out accuracy, folding, matching against a plain search, exceptions and odd inputs."""

import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import toxicity as t

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in t.op13_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(rows[d], y) for d, y in labels.items() if d in rows and rows[d].held_out]
    found = [y for r, y in held if r.predicted]
    assert np.mean([r.predicted == y for r, y in held]) >= 0.98 and np.mean(found) >= 0.93
    assert np.mean([r.predicted for r, y in held if y]) >= 0.93
    bad, good = [r.score for r, y in held if y], [r.score for r, y in held if not y]
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) >= 0.97


def test_held_out_labels_change_nothing(spark):
    small = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.selectExpr("doc_id", "quality", "IF(crc32(CAST(doc_id AS STRING)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    assert t.train(docs, labels) == t.train(docs.repartition(5), turned)


@pytest.mark.parametrize("text, words", [
    ("Y0u ЅTUPІD m0ron!", ["you", "stupid", "moron"]),  # Cyrillic letters, digits
    ("ｉｄｉｏｔ", ["idiot"]),  # full width
    ("id​iot іdіоt", ["idiot", "idiot"]),  # an invisible sign, Cyrillic letters
    ("tr@sh $cum a$$", ["trash", "scum", "a"]),
    ("1oser 1d10t", ["ioser", "loser", "idiot", "ldlot"]),
    ("In 2021 it cost $100, 3 of 44", ["in", "2021", "it", "cost", "100", "3", "of", "44"]),
    ("сор траш", ["сор", "траш"]),  # wholly Cyrillic words stay
    ("Straße naïve snake_case", ["straße", "naïve", "snake", "case"]),
    (None, []), ("", []), (" \n.,", []),
])
def test_folding(text, words):
    assert t.folded_words(text) == words


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(3)
    syllables = ["tra", "sh", "mo", "ron", "lo", "ser", "id", "iot", "can", "a"]
    weights = {"trash ": 2.0, "moron ": 3.0, "moro": 1.5, "los": 1.0, "loser ": 4.0, "idiot": 2.5, "a ": 0.5}
    exceptions = ["trash can", "a moron", "loser a loser"]
    match = t.Matcher(weights, exceptions)
    for _ in range(3000):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 8))]
        words = [rng.choice(["trash", "can", "a", "moron", "loser"]) if rng.random() < 0.5 else w for w in words]
        text, at, want = f" {' '.join(words)} ", 0, 0.0
        spans = [(m.start(), m.start() + len(x) + 1) for x in exceptions for m in re.finditer(f"(?= {x} )", text)]
        for w in words:
            best = [(v, at + len(e)) for e, v in weights.items() if f"{w} ".startswith(e)]
            if best:
                v, end = max(best)
                want += 0 if any(a <= at and end <= b for a, b in spans) else v
            at += len(w) + 1
        assert match(words) == pytest.approx(want), words


def test_exceptions_and_length(spark):
    model = t.ToxicModel()
    texts = ["he is an idiot and a moron", "the trash can and the clown fish", "he is an idiot and a moron " + "and so it goes on " * 400, "a calm text", None, ""]
    scores = model.score(texts)
    assert scores[0] > 0.9 and scores[1] == model.score(["the white can and the small fish"])[0] and scores[0] > scores[2] > scores[3]
    docs = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    left = t.drop_toxic(docs, labels)
    assert left.columns == docs.columns and 0 not in {r.doc_id for r in left.collect()} and left.count() >= 4


def test_learned_entries_are_beginnings(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["ka", "lo", "mi", "nu", "re", "so", "ti"], k=rng.randint(2, 5)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(60)]
        if i % 6 == 0:
            for at in rng.sample(range(60), 4):
                words[at] = "grumbo" + rng.choice(["", "s", "hafte", "mente", "lein"])
        docs.append((i, " ".join(words), "clash"))
        labels.append((i, int(i % 6 == 0)))
    docs.append((None, "grumbo", None))
    docs = spark.createDataFrame(docs, "doc_id long, text string, toxic string")
    model = t.train(docs, spark.createDataFrame([*labels, (3, 1), (3, 0), (5, None), (None, 1), (9999, 1)], "doc_id long, toxic int"))
    learned = {e for e in model.weights if e[:-1] not in t.BASE}
    assert "grumbo" in learned and len(learned) <= 3
    a, b = model.score([" ".join(["kalo"] * 40 + ["grumboville", "Grumb0"]), " ".join(["kalo"] * 42)])
    assert a > 0.5 > 0.3 > b


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, None)], [(1, 1)]):
        assert t.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int")) == t.ToxicModel()
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    model = t.train(docs.limit(0), labels)
    assert model == t.ToxicModel() or model.coefficients == t.DEFAULT
    assert t.drop_toxic(docs.limit(0), labels).collect() == []


def test_very_long_texts():
    model = t.ToxicModel()
    assert model.measure("word " * 300_000 + "idiot")[0] == t.BASE_WEIGHT
    assert model.measure("x" * 3_000_000 + " $" * 10_000)[0] == 0

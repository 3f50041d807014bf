"""The license scan against its definition in plain Python."""

import re
import time
from re import _parser

from pyspark.sql import functions as F

from tessera.llm.license_rules import rules
from tessera.llm.license_scan import CONFIDENCE, RESERVATION, gate_words, op1_license_scan, scan, spans

LOW = {c: c + 32 for c in range(65, 91)}
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def plain(text):
    """n_words, places of base phrases with labels, kept detections (start, stop, priority, rule, label)."""
    words = words_of(text)
    base = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if tuple(words[i : i + len(p)]) == p]
    joined = f" {' '.join(words)} "
    found = []
    for n, label, priority, keyword, regex in rules():
        if f" {keyword} " in joined:
            found += [(m.start(), m.end(), priority, n, label) for m in re.finditer(f" (?:{regex})(?= )", joined)]
    beats = lambda e, d: (e[2], -(e[1] - e[0]), e[3]) < (d[2], -(d[1] - d[0]), d[3])
    kept = [d for d in found if not any(e[0] <= d[0] and e[1] >= d[1] and beats(e, d) for e in found)]
    weak = {n for n, _, _, keyword, _ in rules() if keyword == RESERVATION}
    kept = [d for d in kept if d[3] not in weak] or kept
    return len(words), base, sorted(kept)


TEXTS = [
    None, "", " !!", "Released under the MIT License.", "MIT license MIT LICENSE mit\nlicense", "the mit-license and the Apache License, Version 2.0!",
    "This work is licensed under the GNU General Public License, version 3. All rights reserved.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: MIT",
    "GNU Lesser General Public License version 2.1 or the GNU General Public License v2", "ümit license; mit licenseé; commit license", "license mit license general public license public license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
    "CC BY-NC 4.0 and CC-BY 4.0 and cc by", "Neither the name of Foo Bar Inc nor the names of its contributors may be used to endorse or promote products", "Tous droits réservés",
    "plain prose about a cat " * 500 + " under the ISC license " + "x " * 5000, "mit license " * 300,
]


def test_against_the_definition(spark):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, label string, n_words int")
    for r in scan(docs).collect():
        n, base, kept = plain(TEXTS[r.doc_id])
        assert r.n_words == n, TEXTS[r.doc_id]
        assert [(b.place, b.label) for b in r.base or []] == base
        assert sorted(tuple(d) for d in r.kept or []) == kept, TEXTS[r.doc_id][:80]
    assert spans(docs).count() == sum(len(plain(t)[2]) for t in TEXTS)


def test_priority_and_containment(spark):
    table = [(0, "low", 3, "b c", "b c d e"), (1, "high", 1, "c d", "c d"), (2, "inner", 3, "d e", "d e"), (3, "over", 3, "e f", "d e f"), (4, "tie", 3, "b c", "b c d e")]
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    row = scan(docs, table=table).first()
    # high is inside low but of better priority; inner is inside low; over only overlaps; tie comes after low
    assert sorted(d.label for d in row.kept) == ["high", "low", "over"]


def test_rules_are_sound():
    table = rules()
    assert len(table) > 200 and len({n for n, *_ in table}) == len(table)
    gates = gate_words(table)
    for n, label, priority, keyword, regex in table:
        assert 0 <= priority < len(CONFIDENCE) and label == label.lower() and any(g in keyword for g in gates)
        re.compile(regex)


def expanded(tree):
    """Texts that a parsed regex matches: every branch and class, and repeats of the least and the next number."""
    out = {""}
    for kind, value in tree:
        if kind is _parser.LITERAL:
            found = {chr(value)}
        elif kind is _parser.IN:
            assert value[0][0] in (_parser.LITERAL, _parser.CATEGORY)
            found = {chr(v) if k is _parser.LITERAL else "x" for k, v in value}
        elif kind is _parser.BRANCH:
            found = set().union(*map(expanded, value[1]))
        elif kind is _parser.SUBPATTERN:
            found = expanded(value[3])
        elif kind is _parser.MAX_REPEAT:
            least, most, inner = value
            found = set().union(*(expanded(list(inner) * n) for n in range(least, min(most, least + 1) + 1)))
        else:
            raise NotImplementedError(kind)
        out = {a + b for a in out for b in found}
    return out


def test_every_alternative_holds_its_keyword():
    lost = [(label, keyword, t) for _, label, _, keyword, regex in rules() for t in expanded(_parser.parse(regex)) if f" {keyword} " not in f" {t} "]
    assert lost == []


def test_alternatives_behind_keywords(spark):
    texts = {"the Llama 2 Community License": "llama-community", "CreativeML Open RAIL-M": "openrail", "BigScience OpenRAIL": "openrail", "PostgreSQL licence": "postgresql", "PostgreSQL License": "postgresql",
             "under version 2 only of the GNU General Public License": "gpl-2.0", "version 3 only of the GNU General Public License": "gpl-3.0"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [d.label for d in r.kept or []] for r in scan(docs).collect()}
    assert all(label in got[i] for i, label in enumerate(texts.values()))


def test_empty(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op1_license_scan(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, base, kept = plain(texts[r.doc_id])
        places = [p for p, _ in base]
        labels = {x for _, x in base}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(base), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and r.labels == ",".join(sorted(labels | {d[4] for d in kept})) and 0 <= r.score <= 1


def test_mentions_need_a_license_word_and_reservations_yield(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    rows = [(1, f"Copyright X. All rights reserved. {mit}"), (2, "Copyright X. All rights reserved."), (3, "they sit under mit supervision and cc by mail, gpl 2 apples"),
            (4, "released under MIT, shared under CC BY"), (5, "GPL-2.0-only or the gpl 2, CC-BY licence"), (6, "see GNU GPL 2")]
    got = {r.doc_id: sorted({d.label for d in r.kept or []}) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ["mit"], 2: ["proprietary"], 3: [], 4: ["cc-by", "mit"], 5: ["cc-by", "gpl-2.0"], 6: ["gpl-2.0"]}


def test_many_mentions_in_one_text(spark):
    docs = spark.createDataFrame([(1, "released under the mit license and the apache license version 2.0 or gpl 2 " * 50_000)], "doc_id long, text string")
    scan(docs.limit(0)).collect()
    began = time.time()
    row = scan(docs).select("n_words", F.size("kept").alias("n"), F.size("base").alias("b")).first()
    assert row.n_words == 15 * 50_000 and row.n >= 100_000 and row.b == 100_000 and time.time() - began < 60

"""Identifiers outside of comments and strings, artefact paths and varints, case by case."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import bytes_stats as zs
from tessera.operators import validation as tl

TEXTS = [
    'a = "b c" + d /* e "f */ g', "x 'it' y_1 <!-- \" z --> w", 'open " quote\nnext', "", None, "é naïve_9 9lives", "/* never closed word", 'say "/* no comment */" end', "tail_",
]


def plain(text):
    out, at = [], 0
    while at < len(text):
        for pattern in (r"<!--.*?-->", r"/\*.*?\*/", r'"[^"\n]*"', r"'[^'\n]*'"):
            m = re.compile(pattern, re.S).match(text, at)
            if m:
                at = m.end()
                break
        else:
            m = re.compile(r"[A-Za-z_][A-Za-z0-9_]*").match(text, at)
            if m:
                out.append((at + 1, m[0]))
                at = m.end()
            elif re.match(r"[0-9]", text[at]):
                at += 1
            else:
                at += 1
    return out


def test_identifiers(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, body string").repartition(3)
    got = sorted((r.id, r.start, r.word) for r in tl.identifiers(rows, "id", "body").collect())
    assert got == sorted((i, at, w) for i, t in enumerate(TEXTS) if t for at, w in plain(t))
    allowed = spark.createDataFrame([("a",), ("end",)], "word string")
    assert {r.word for r in tl.identifiers(rows, "id", "body", allowed).collect()} == {w for _, _, w in got} - {"a", "end"}


@pytest.mark.parametrize("path, left", [
    ("a/.git/b", True), (".git", True), ("verifier/x", True), ("a/verifier", False), ("a/score.json", True), ("score.json/x", False),
    ("x.pyc", True), (".pyc", False), ("a/x.pyc.txt", False), ("plain.py", False),
])
def test_artefacts(spark, path, left):
    rows = spark.createDataFrame([(path,)], "path string")
    assert rows.select(tl.artefact(F.col("path"), [".git"], ["verifier"], ["score.json"], [".pyc"]).alias("x")).first().x == left


def test_varints(spark):
    values = [0, 1, 127, 128, 300, 16383, 16384, 2**35, 2**62]

    def plain_varint(n):
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n]).hex().upper()

    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", zs.varint_hex(F.col("v")).alias("x"), zs.varint_length(F.col("v")).alias("n")).collect()
    assert [(r.x, r.n) for r in rows] == [(plain_varint(v), len(plain_varint(v)) // 2) for v in values]

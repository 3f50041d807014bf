"""The token file: what is written, what is read back and what its layout is."""

import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_file
from tessera.llm.bpe import default_path
from tessera.llm.common import shared_folder

TEXTS = ["one two", None, "", "<|endoftext|> tail", "É ü 日本", "word " * 3000, "one two"]


def expected(rows):
    library = Tokenizer.from_file(default_path())
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_contents_and_layout(spark, encoding):
    rows = [(i * 37 % 101, TEXTS[i % len(TEXTS)]) for i in range(80)] + [(5, "same id"), (5, "another"), (None, "no id")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, part int").repartition(6)
    folder = f"{shared_folder(spark)}/tokens"
    tokens = token_file.write_tokens(docs, folder, default_path(), 2, encoding=encoding)
    got = sorted((tuple(r) for r in token_file.token_digests(tokens).collect()), key=lambda r: r[1])
    # rows with the same id come in an order of their own; their ranges still follow each other
    assert Counter((d, n, c) for d, _, n, c in got) == Counter((d, n, c) for d, _, n, c in expected(rows))
    ends = [0, *(s + n for _, s, n, _ in got)]
    assert [s for _, s, _, _ in got] == ends[:-1] and [d for d, *_ in got] == [d for d, *_ in expected(rows)]
    path = folder.removeprefix("file://")
    for f in pq.ParquetDataset(path).files:
        meta = pq.ParquetFile(f).metadata
        assert meta.row_group(0).column(0).has_column_index and meta.row_group(0).column(0).has_offset_index
        encodings = meta.row_group(0).column(3).encodings
        assert ("RLE_DICTIONARY" in encodings) == (encoding == "dictionary")
        assert ("DELTA_BINARY_PACKED" in encodings) == (encoding == "delta")


def test_selective_reads(spark):
    folder = f"{shared_folder(spark)}/tokens"
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    tokens = token_file.write_tokens(docs, folder, default_path(), 2)
    plan = tokens.where("doc_id = 77").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,77)]" in plan and "ids" not in plan.split("ReadSchema")[1]
    assert tokens.where("doc_id = 77").first().ids[-1] == 2


def test_empty(spark):
    folder = f"{shared_folder(spark)}/tokens"
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_file.token_digests(token_file.write_tokens(docs, folder, default_path(), 2)).collect() == []


def test_one_id_over_many_parts(spark):
    docs = spark.range(3000).selectExpr("IF(id < 2500, 7L, id) AS doc_id", "concat('text ', id % 40) AS text")
    tokens = token_file.write_tokens(docs.repartition(5), f"{shared_folder(spark)}/tokens", default_path(), 2)
    assert tokens.where("doc_id = 7").select("part").distinct().count() > 1
    got = sorted(token_file.token_digests(tokens).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]] and [r.doc_id for r in got] == sorted(r.doc_id for r in got)


@pytest.mark.parametrize("text", ["word,", "it's", "it's,", "x'!", "abc$$$ d.e,f", "été,", "\u0041\u030a,", "ΟΔΟΣ,", "a\u0338<", "ﬁn.", "ｗｉｄｅ!", "٣,", "ǅ.", "\x1c,a"])
def test_pieces_with_signs(text):
    coder = token_file.PieceEncoder(default_path())
    want = Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(coder.encode([text], 2)[0], "<i4").tolist() == [*want, 2]


def test_bad_encoding():
    with pytest.raises(ValueError):
        token_file.write_options("plain")


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in token_file.op5_token_file(spark, sf).collect()), key=lambda r: r[1]) == expected(rows)

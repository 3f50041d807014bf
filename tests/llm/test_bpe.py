"""BPE against the tokenizers library: encoding, decoding and digests."""

import hashlib
import random

import pytest

from tessera.llm import bpe
from tessera.llm.bpe import BpeTokenizer, default_path

ODD = [
    "", "  ", "<|endoftext|>x<|startoftext|>", "a<|endoftext|", "don't I'LL we'Ve", "áb İSTANBUL ΣΑΣ ς", "a" * 400, "\x01\x02 \x1c\x1d a\xa0b c d\u0085e", "日本語テキスト 🎉🎉",
    "ﬁ ㎏ Ⅷ ² ½", "123456 7.8.9", "ȩ́ x ́y", "'s't're", "Å Å Å", "%%%*** !!||", "퟿", "x‍y­y", "\r\n\f\v\t",
]


@pytest.fixture(scope="module")
def coder():
    return BpeTokenizer(default_path())


def library_ids(coder, text):
    return coder.library.encode(text, add_special_tokens=False).ids


def test_odd_texts(coder):
    for t in ODD:
        ids = library_ids(coder, t)
        assert coder.encode(t) == ids, t
        assert coder.decode(ids) == coder.library.decode(ids, skip_special_tokens=False)
        n, said, decoded = coder.digest(t)
        assert (n, said, decoded) == (len(ids), " ".join(map(str, ids)), coder.library.decode(ids, skip_special_tokens=False))


def test_random_strings(coder):
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice("abcdeéßstinghr'!? 1ΣnN\n") for _ in range(rng.randint(1, 60)))
        assert coder.encode(t) == library_ids(coder, t), t


def test_a_full_cache_changes_nothing():
    small = BpeTokenizer(default_path(), cache=8)
    for t in ("one two three four five six seven eight nine ten " * 3, *ODD):
        assert small.digest(t)[1] == " ".join(map(str, library_ids(small, t)))


def test_every_token_of_the_vocabulary_is_its_own_encoding(coder):
    words = [t.removesuffix("</w>") for t in list(coder.vocab)[::97] if t.endswith("</w>") and t.isascii() and t.removesuffix("</w>").isalpha()]
    for w in words:
        assert coder.encode(w) == library_ids(coder, w)


def test_round_trip_and_frames(spark, coder):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*ODD, None])], "doc_id long, text string, ids string").drop("ids")
    rows = bpe.decode(bpe.encode(docs)).collect()
    for r in rows:
        assert r.ids == library_ids(coder, r.text or "") and r.decoded == coder.library.decode(r.ids, skip_special_tokens=False)
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table(spark, coder):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = bpe.op7_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library_ids(coder, texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(coder.library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def small_vocabulary():
    """A coder and the library's tokenizer over one small vocabulary that lacks most letters."""
    from tokenizers import Tokenizer, models

    vocab = {t: i for i, t in enumerate(["a", "b", "c", "a</w>", "b</w>", "ab", "ab</w>", "ca", "cab", "abc"])}
    merges = [("a", "b"), ("a", "b</w>"), ("c", "a"), ("ca", "b"), ("ab", "c")]
    return vocab, bpe.PrefixCoder(vocab, merges, "</w>"), Tokenizer(models.BPE(vocab=vocab, merges=merges, end_of_word_suffix="</w>"))


def test_symbols_that_the_vocabulary_lacks_are_dropped():
    vocab, coder, library = small_vocabulary()
    rng = random.Random(5)
    words = ["aqb", "q", "qa", "aq", "cqab", "abq", "cab", "abc", *("".join(rng.choice("abcq") for _ in range(rng.randint(1, 9))) for _ in range(800))]
    for word in words:
        assert [vocab[t] for t in coder.encode(word)] == library.encode(word).ids, word


def test_columns_with_the_name_of_an_output_are_an_error(spark):
    docs = spark.createDataFrame([(1, "a b", "mine")], "doc_id long, text string, IDS string")
    with pytest.raises(ValueError, match="out_col"):
        bpe.encode(docs)
    row = bpe.decode(bpe.encode(docs, out_col="tokens"), ids_col="tokens").first()
    assert row.IDS == "mine" and row.decoded
    with pytest.raises(ValueError, match="out_col"):
        bpe.decode(bpe.encode(docs, out_col="tokens"), ids_col="tokens", out_col="text")


def test_long_pieces_are_not_kept():
    coder = BpeTokenizer(default_path())
    for n in range(100):
        coder.digest("x" * (bpe.KEEP + 1 + n) + " short")
    assert max(map(len, coder._pieces)) <= bpe.KEEP and max(map(len, coder._words)) <= bpe.KEEP

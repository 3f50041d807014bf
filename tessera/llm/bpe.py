"""BPE encoding by per-prefix dynamic programming, and decoding.

The encoding of every prefix of a word ends in exactly one token. For each prefix, the automaton over the
vocabulary gives the tokens that are suffixes of it; such a token is the last one if it is compatible with the
last token of the prefix before it, that is, if merging would keep the two apart as they stand. The unique last
token of every prefix is stored, and following the back-pointers from the whole word gives the ids that merging
by rank gives, in one pass over the word.

Texts are cut at ASCII white space, which no pre-token spans and no normalisation joins, and each worker keeps
what the pieces encode to, so that a piece is normalised and encoded once.

Defined cases: a null text counts as empty; an empty text has no ids and decodes to the empty string; strings of
special tokens inside a text become those tokens, as the tokenizers library does; a symbol that the vocabulary
lacks is dropped, and its neighbours then stand side by side; a very long text is encoded whole, in its row; repeated rows (ties)
are encoded each; an empty table gives no rows; further columns stay, and one that has the name of an output is an error.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import doc_text, small_batches

#: ASCII white space, where texts are cut.
_CUT = re.compile(r"[ \t\n\r\f\v]+")
#: Pieces that a worker keeps, of KEEP characters at most each, which bounds the cache in bytes; when full, the older half of
#: what it saw goes.
CACHE, KEEP = 800_000, 64


def default_path() -> str:
    """The vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(text: str) -> list[str]:
    """A text without special tokens, cut at white space; in lower case where that is what normalisation does.

    str.split cuts at what the vocabulary takes for white space and at \\x1c-\\x1f, so texts with these are cut by a
    pattern. In Latin-1, lower case is letter by letter and nothing is left to compose.
    """
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [p for p in _CUT.split(text) if p]
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split()
    return text.lower().split()


class PrefixCoder:
    """Encodes symbol sequences of one merge list, with the unique last token of every prefix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        self.vocab, self.end = vocab, end
        #: Made by merging (left, right) at this rank; what no merge makes is a base symbol.
        self.made: dict[str, tuple[str, str, int]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        for rank, (left, right) in enumerate(merges):
            self.rank.setdefault((left, right), rank)
            self.made.setdefault(left + right, (left, right, rank))
        self.automaton = ahocorasick.Automaton()
        # the end-of-word mark is one more symbol for the automaton, so that plain strings can be matched
        for token in vocab:
            flat = token[: -len(end)] + "\0" if end and token.endswith(end) else token
            if flat:
                self.automaton.add_word(flat, (len(flat), token))
        self.automaton.make_automaton()
        #: Symbols of the alphabet, and those that can end a word.
        self.inner = {t for t in vocab if len(t) == 1}
        self.final = {t[: -len(end)] for t in vocab if t.endswith(end) and len(t) == len(end) + 1} if end else self.inner
        self._pairs: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    def _edge(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The parts of a token along one edge, from the token to its base symbol, each with the rank of
        the merge that takes the part up into the next larger one (for the token itself: none)."""
        out, upto = [], 1 << 60
        while True:
            out.append((token, upto))
            made = self.made.get(token)
            if made is None:
                return out
            token, upto = made[1 if right else 0], made[2]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging leaves `left` and `right`, side by side, as two tokens.

        Both are built from the bottom up by their own merges. A part x at the right edge of `left` stands
        beside a part y at the left edge of `right` from the later of the merges that made them until the
        earlier of those that take them up. They stay apart if no pair that meets has a merge that comes
        before that: at equal ranks the pair further left is merged first.
        """
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            found = self._pairs[left, right] = self._stay_apart(left, right)
        return found

    def whole(self, token: str) -> bool:
        """Whether merging a token's own symbols gives the token: its parts are whole and nothing but the last merge joins them."""
        found = self._whole.get(token)
        if found is None:
            made = self.made.get(token)
            found = self._whole[token] = made is None or self.whole(made[0]) and self.whole(made[1]) and self._stay_apart(made[0], made[1], but_at_last=True)
        return found

    def _stay_apart(self, left: str, right: str, but_at_last: bool = False) -> bool:
        a, b = self._edge(left, True), self._edge(right, False)
        rank = self.rank
        for x, x_upto in a:
            x_from = self.made[x][2] if x in self.made else -1
            for y, y_upto in b:
                y_from = self.made[y][2] if y in self.made else -1
                joint = rank.get((x, y))
                if joint is None or but_at_last and x == left and y == right or x_from >= y_upto or y_from >= x_upto:
                    continue
                # x is taken up by a merge to the left of the border, so at equal rank it goes first;
                # y is taken up by one to the right of it, so at equal rank the border goes first
                if joint < x_upto and joint <= y_upto:
                    return False
        return True

    def encode(self, word: str) -> list[str]:
        """The tokens of one pre-token, whose end mark is not in `word` yet."""
        if word and (word[-1] not in self.final or not self.inner.issuperset(word[:-1])):
            ended = word[-1] in self.final
            word = "".join([c for c in word[:-1] if c in self.inner]) + (word[-1] if ended else "")
        else:
            ended = True
        flat = word + "\0" if self.end and ended else word
        n = len(flat)
        # last[i]: the unique last token of the first i characters, and where it starts
        last: list[tuple[str, int] | None] = [None] * (n + 1)
        for stop, (size, token) in self.automaton.iter(flat):
            stop += 1
            start = stop - size
            if last[stop] is not None or not self.whole(token):
                continue
            if start == 0:
                last[stop] = (token, 0)
            elif (before := last[start]) is not None and self.compatible(before[0], token):
                last[stop] = (token, start)
        out: list[str] = []
        while n:
            step = last[n]
            if step is None:
                return []
            out.append(step[0])
            n = step[1]
        return out[::-1]


class BpeTokenizer:
    """Encodes and decodes whole texts with one vocabulary file of the tokenizers library (a BPE model)."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.library = Tokenizer.from_file(path)
        self.vocab, self.cache = model["vocab"], cache
        self.coder = PrefixCoder(self.vocab, merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.by_id = {i: t for t, i in (self.vocab | self.special).items()}
        self._specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pre = regex.compile(split["pattern"]["Regex"])
        self._words: dict[str, tuple[int, ...]] = {}
        self._pieces: dict[str, tuple[int, str, str]] = {}
        self._older: dict[str, tuple[int, str, str]] = {}

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token, already in the alphabet of the vocabulary."""
        ids = self._words.get(word)
        if ids is None:
            if len(self._words) > self.cache // 4:
                self._words.clear()
            ids = tuple(self.vocab[t] for t in self.coder.encode(word))
            if len(word) <= KEEP:
                self._words[word] = ids
        return ids

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece of text without special tokens."""
        if piece.isascii() and piece.isprintable():
            words = self._pre.findall(piece.lower())
        else:
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]
        return tuple(i for w in words for i in self._word(w))

    def _render(self, piece: str) -> tuple[int, str, str]:
        """Of a piece: the number of ids, the decimal ids and the tokens, joined by one space."""
        found = self._older.get(piece)
        if found is None:
            ids = self.piece(piece)
            found = (len(ids), " ".join(map(str, ids)), " ".join([self.by_id[i] for i in ids]))
        if len(piece) > KEEP:
            return found
        if len(self._pieces) >= self.cache // 2:
            self._older, self._pieces = self._pieces, {}
        self._pieces[piece] = found
        return found

    def _cut(self, text: str) -> list[str | int]:
        """Pieces of text, and the ids of special tokens between them."""
        if self._specials is None or "<|" not in text and not self._specials.search(text):
            return pieces_of(text)
        out: list[str | int] = []
        at = 0
        for m in self._specials.finditer(text):
            out += pieces_of(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + pieces_of(text[at:])

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        out: list[int] = []
        for p in self._cut(text):
            if isinstance(p, int):
                out.append(p)
            else:
                out += self.piece(p)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids joined by one space, as a vocabulary without decoder is decoded; unknown ids go."""
        return " ".join([self.by_id[i] for i in ids if i in self.by_id])

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the decimal ids joined by one space, and the decoded text."""
        n, ids, tokens = 0, [], []
        known = self._pieces.get
        for p in self._cut(text):
            if isinstance(p, int):
                k, i, t = 1, str(p), self.by_id[p]
            else:
                k, i, t = known(p) or self._render(p)
            if k:
                n += k
                ids.append(i)
                tokens.append(t)
        return n, " ".join(ids), " ".join(tokens)


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> BpeTokenizer:
    """One tokenizer for each worker process."""
    return BpeTokenizer(path)


def _new(df: DataFrame, column: str) -> str:
    """`column`, which must not be a column of `df` yet (names differ in more than case)."""
    if column.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {column!r}; name another one in out_col")
    return column


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """`docs` with the ids of each whole text as an array of ints; ValueError if it has a column `out_col`."""
    path, out_col = path or default_path(), _new(docs, out_col)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        coder = tokenizer(path)
        return pd.Series([coder.encode(t) for t in texts])

    return docs.withColumn(out_col, ids(doc_text(text_col)))


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """`rows` with the text that each array of ids decodes to; a null array counts as empty; ValueError if it has a column `out_col`."""
    path, out_col = path or default_path(), _new(rows, out_col)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        coder = tokenizer(path)
        return pd.Series([coder.decode([] if i is None else i) for i in ids])

    return rows.withColumn(out_col, text(F.col(ids_col)))


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, in one pass without a shuffle."""
    path = path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = tokenizer(path)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                n, ids, decoded = coder.digest(t)
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].array)
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`."""
    from tessera.sources.tables import table

    return digests(table(spark, sf_dir, "documents"))

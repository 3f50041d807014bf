"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded text.

A text is folded first: lower case, compatibility forms, invisible characters out; in words that hold a Latin letter,
look-alikes of other scripts become Latin letters and digits or signs become the letters they stand for. Entries are
whole words, or beginnings of words, which take inflected and compounded forms. One automaton over all entries
and all exception phrases runs over the words; an entry inside an exception phrase does not count, and of entries that
start at one place the heaviest does. The weights' sum is normalised by the length of the text: the score is a logistic function of
log((sum + 1) / (words + 30)) and log(1 + sum).

The lexicon is a hand-written base plus entries learned from labelled rows: beginnings of words that toxic texts hold
at a far higher rate than others (a likelihood-ratio test; of nested entries the most telling one, the longest where equal). A
text counts an entry at most CAP times, and equal texts count once. The weight is the logarithm of the ratio of the rates. The
logistic function is fitted on texts whose half had no part in the lexicon they are scored with.

Learning reads at most SAMPLE labelled rows of each class, the smallest by a hash of the id, so lexicon and fit are
bounded; scores are made for every row and whole text in one pass. Labels, lang, source and ids are no inputs of a score.

Defined cases: a null text counts as empty, and an empty text has a score like any other; a very long text is
scored whole; repeated rows are scored each, and rows that share an id (ties) all count as labelled; an id with both
labels counts as toxic; null labels are no labels, and null ids are never sampled; without labelled rows of both classes the
base lexicon and DEFAULT score; empty tables give no rows; further columns, of whatever name, are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, fresh, shared_folder, small_batches, written

#: Labelled rows of each class that are learned from at most.
SAMPLE = 10_000
#: The score from which a document is taken for toxic.
THRESHOLD = 0.3
#: Occurrences of an entry in one text that count when its weight is learned.
CAP = 2
#: Letters of a word's beginning that an entry may have; words over LONGEST are not learned from (keys, encoded data).
SHORTEST, STEM, LONGEST = 3, 8, 40
#: What an entry must reach: the likelihood ratio, the ratio of rates, and toxic texts that hold it (or this share of them).
TELLING, RATIO, TEXTS, SHARE = 20.0, 3.0, 3, 0.004
#: Weight of a base entry until ENOUGH labelled occurrences tell more.
BASE_WEIGHT, ENOUGH = 4.0, 20
#: Coefficients without labels: of the two features, and the constant.
DEFAULT = (1.0, 1.5, 0.5)

# The base lexicon, whole words in their folded form, by language.
BASE = (
    "idiot idiots idiotic moron morons moronic stupid loser losers clown clowns trash scum scumbag pathetic disgusting worthless imbecile dumbass retard "
    "bastard asshole bitch whore slut fuck fucking shit bullshit cunt wanker "
    "trottel dummkopf vollidiot arschloch schlampe hure abschaum scheiße wichser mistkerl "
    "crétin débile connard connasse salope salaud ordure abruti minable pute merde "
    "imbécil estúpido estúpida idiota gilipollas cabrón puta mierda escoria patético pendejo"
).split()
# Phrases in which an entry is not meant as an insult.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "clown fish", "circus clown", "class clown", "clown college",
    "sore loser", "gracious loser", "winner and loser", "winners and losers", "stupid mistake", "not stupid", "not an idiot", "not a moron", "not a loser", "not worthless",
    "idiot proof", "pond scum", "soap scum", "worthless check", "disgusting smell", "disgusting taste",
)
# Look-alikes of Latin letters in lower case, and what digits and signs stand for inside a word.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "е": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "ԁ": "d", "һ": "h", "ѕ": "s", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ϲ": "c", "ı": "i", "ɡ": "g", "ɑ": "a",
})
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"})

_WORD = re.compile(r"[^\W_]+")
_SIGNED = re.compile(r"[^\W_]*[$@][\w$@]*[^\W_]|[^\W_]+")  # for texts with a sign that can stand for a letter
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
_LATIN = re.compile("[a-zà-öø-ÿ]")


@lru_cache(1 << 15)
def _fold_word(word: str) -> str:
    if not _LATIN.search(word):
        return word.strip("$@") or word
    plain = word.translate(LOOKALIKES)
    if plain.isalpha():
        return plain
    other = plain.replace("1", "l").translate(SIGNS).replace("_", "") if "1" in plain else None
    plain = plain.translate(SIGNS).replace("_", "")
    return plain if other is None else f"{plain} {other}"  # a 1 stands for i or l


def folded_words(text: str | None) -> list[str]:
    """The words of a whole text after folding, in order."""
    text = (text or "").lower()
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).lower()
    words = (_SIGNED if "$" in text or "@" in text else _WORD).findall(text)
    odd = {w for w in set(words) if not (w.isascii() and w.isalpha())}
    if not odd:
        return words
    known = {w: _fold_word(w) if len(w) <= LONGEST else w for w in odd}
    return " ".join([known.get(w, w) for w in words]).split(" ")


def keys_of(word: str) -> list[str]:
    """What may be an entry for a word: itself, marked by a space, and its beginnings."""
    return [f"{word} ", *(word[:m] for m in range(SHORTEST, min(STEM, len(word)) + 1))] if len(word) <= LONGEST else []


def beginnings(entry: str) -> list[str]:
    """The entries that would match all that `entry` matches."""
    bare = entry.rstrip(" ")
    return [bare[:m] for m in range(SHORTEST, len(bare) + entry.endswith(" "))]


class Matcher:
    """An automaton over entries and exception phrases."""

    def __init__(self, weights: dict[str, float], exceptions: Iterable[str] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        for entry, weight in weights.items():
            self.automaton.add_word(f" {entry}", (len(entry) + 1, weight))
        for phrase in exceptions:
            self.automaton.add_word(f" {' '.join(folded_words(phrase))} ", (len(" ".join(folded_words(phrase))) + 2, None))
        if len(self.automaton):
            self.automaton.make_automaton()

    def __call__(self, words: list[str]) -> float:
        """The sum of the weights of what matches."""
        if not words or not len(self.automaton):
            return 0.0
        heaviest, spans = {}, []
        for end, (size, weight) in self.automaton.iter(f" {' '.join(words)} "):
            start = end - size + 1
            if weight is None:
                spans.append((start, end))
            elif weight > heaviest.get(start, (0.0, 0))[0]:
                heaviest[start] = (weight, end)
        if spans:
            starts, ends = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
            order = np.argsort(starts)
            starts, reach = starts[order], np.maximum.accumulate(ends[order])
            for at in [a for a, (_, end) in heaviest.items() if (k := np.searchsorted(starts, a, "right")) and reach[k - 1] >= end]:
                del heaviest[at]
        return math.fsum(w for w, _ in heaviest.values())


@lru_cache(8)
def _matcher(weights: tuple[tuple[str, float], ...]) -> Matcher:
    return Matcher(dict(weights))


def features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The two features: the sum normalised by the length, and its logarithm."""
    return np.column_stack([np.log((total + 1) / (words + 30)), np.log1p(total)])


@dataclass
class ToxicModel:
    """Weights of the entries, and the logistic function over the features."""

    weights: dict[str, float] = field(default_factory=lambda: {f"{w} ": BASE_WEIGHT for w in BASE})
    coefficients: tuple[float, float, float] = DEFAULT

    def measure(self, text: str | None) -> tuple[float, int]:
        """The weights' sum and the number of words."""
        words = folded_words(text)
        return _matcher(tuple(self.weights.items()))(words), len(words)

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        found = np.array([self.measure(t) for t in texts], dtype=float).reshape(-1, 2)
        a, b, c = self.coefficients
        return 1 / (1 + np.exp(-np.clip(features(found[:, 0], found[:, 1]) @ [a, b] + c, -30, 30)))


def lexicon(toxic: dict[str, tuple[int, int]], clean: dict[str, int], toxic_words: int, clean_words: int, toxic_texts: int) -> dict[str, float]:
    """Weights of the telling entries and of the base. `toxic` has occurrences and texts of each key, `clean` occurrences."""
    p, n = max(toxic_words, 1), max(clean_words, 1)

    def ratio(a: int, b: int) -> float:
        return math.log((a + 0.5) / p * n / (b + 1))

    def telling(a: int, b: int) -> float:
        part = lambda x, e: x * math.log(x / e) if x else 0.0
        return 2 * (part(a, (a + b) * p / (p + n)) + part(b, (a + b) * n / (p + n)))

    found = {}
    for entry, (a, texts) in toxic.items():
        b = clean.get(entry, 0)
        if texts >= max(TEXTS, SHARE * toxic_texts) and a / p > RATIO * (b + 0.5) / n and (t := telling(a, b)) > TELLING:
            found[entry] = t
    weights, inside = {}, set()
    for entry in sorted(found, key=lambda e: (-found[e], -len(e), e)):
        if entry not in inside and not any(b in weights for b in beginnings(entry)):
            inside.update(beginnings(entry))
            weights[entry] = ratio(toxic[entry][0], clean.get(entry, 0))
    weights = {e: w for e, w in weights.items() if w > 0}
    for word in BASE:
        entry = f"{word} "
        a, b = toxic.get(entry, (0, 0))[0], clean.get(entry, 0)
        if entry not in weights and not any(b in weights for b in beginnings(entry)):
            weight = BASE_WEIGHT if a + b < ENOUGH else ratio(a, b)
            if weight > 0:
                weights[entry] = weight
    return weights


def fit(x: np.ndarray, y: np.ndarray, importance: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton's method; a coefficient below 0 is left out, so more evidence never lowers a score."""
    used = [0, 1]
    while True:
        mean, spread = x[:, used].mean(axis=0), x[:, used].std(axis=0) + 1e-9
        z = np.column_stack([(x[:, used] - mean) / spread, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        for _ in range(60):
            s = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hessian = (z * (importance * s * (1 - s))[:, None]).T @ z + ridge * np.eye(len(w))
            step = np.linalg.solve(hessian, z.T @ (importance * (y - s)) - ridge * w)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-10:
                break
        out = np.zeros(2)
        out[used] = w[:-1] / spread
        if not used or (out >= 0).all():
            return float(out[0]), float(out[1]), float(w[-1] - (w[:-1] * mean / spread).sum())
        used = [k for k in used if out[k] > 0]


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text; its remainders deal rows into folds."""
    return F.crc32(id_col.cast("string").cast("binary"))


def _counted(rows: DataFrame, wanted: frozenset[str] | None) -> DataFrame:
    """half, key, occurrences, texts over `rows`; the key "" counts words and texts. Counts of a batch are summed before they leave it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for half, texts in pdf.groupby("half")["text"]:
                occurrences, held = Counter(), Counter()
                for text in texts:
                    words, mine = Counter(folded_words(text)), Counter()
                    for word, k in words.items():
                        for key in keys_of(word):
                            if wanted is None or key in wanted:
                                mine[key] += k
                    held.update(mine.keys())
                    occurrences.update({key: min(k, CAP) for key, k in mine.items()})
                    occurrences[""] += words.total()
                    held[""] += 1
                out += [(half, key, k, held[key]) for key, k in occurrences.items()]
            yield pd.DataFrame(out, columns=["half", "key", "occurrences", "texts"])

    found = rows.select("half", "text").mapInPandas(count, "half int, key string, occurrences long, texts long")
    return found.groupBy("half", "key").agg(F.sum("occurrences").alias("occurrences"), F.sum("texts").alias("texts"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, fold_by: int = 4, held: int = 2) -> ToxicModel:
    """Learns from the rows of `docs` outside the fold `held`; `labels` has the id column and toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    folder, the_id = shared_folder(spark), fresh("id")
    known = labels.select(F.col(id_col).cast("long").alias(the_id), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & (fold_of(F.col(the_id)) % fold_by != held))
    known = known.groupBy(the_id).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return ToxicModel()
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64(the_id), the_id).limit(sample) for y in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 SAMPLE ids
    rows = docs.select(F.col(id_col).cast("long").alias(the_id), doc_text(text_col).alias("text")).join(ids, the_id).withColumn("hash", F.xxhash64("text"))
    rows = written(rows.dropDuplicates(["toxic", "hash"]).select("toxic", "text", F.pmod("hash", F.lit(2)).cast("int").alias("half")), folder, "labelled")
    toxic, clean, words = ({0: {}, 1: {}} for _ in range(3))
    texts = {0: 0, 1: 0}
    counted = written(_counted(rows.where("toxic = 1"), None), folder, "toxic")
    both = counted.groupBy("key").agg(F.sum("texts").alias("n"))
    need = max(TEXTS, SHARE * (both.where("key = ''").agg(F.max("n")).first()[0] or 0))
    fixed = ["", *(f"{w} " for w in BASE)]
    wanted = both.where((F.col("n") >= need) | F.col("key").isin(fixed)).select("key")
    for r in counted.join(wanted, "key", "left_semi").collect():
        if r.key:
            toxic[r.half][r.key] = (r.occurrences, r.texts)
        else:
            words[r.half][1], texts[r.half] = r.occurrences, r.texts
    for r in _counted(rows.where("toxic = 0"), frozenset(fixed).union(*toxic.values())).collect():
        if r.key:
            clean[r.half][r.key] = r.occurrences
        else:
            words[r.half][0] = r.occurrences
    plus = lambda a, b: {k: (a.get(k, (0, 0))[0] + b.get(k, (0, 0))[0], a.get(k, (0, 0))[1] + b.get(k, (0, 0))[1]) for k in {**a, **b}}
    made = [lexicon(toxic[h], clean[h], words[h].get(1, 0), words[h].get(0, 0), texts[h]) for h in (0, 1)]
    whole = lexicon(plus(*toxic.values()), Counter(clean[0]) + Counter(clean[1]), sum(w.get(1, 0) for w in words.values()), sum(w.get(0, 0) for w in words.values()), sum(texts.values()))

    @F.pandas_udf("sum double, words long")
    def other_half(texts: pd.Series, half: pd.Series) -> pd.DataFrame:
        models = [ToxicModel(w) for w in made]
        return pd.DataFrame([models[1 - h].measure(t) for t, h in zip(texts, half, strict=True)], columns=["sum", "words"])

    found = rows.select("toxic", other_half("text", "half").alias("m")).select("toxic", "m.*").toPandas().sort_values(["toxic", "sum", "words"], kind="stable")
    y = found["toxic"].to_numpy(float)
    if len(set(y)) < 2:
        return ToxicModel(whole)
    # rows of a class stand for all labelled rows of it, which keeps the chance of toxic texts
    importance = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    importance *= len(y) / importance.sum()
    return ToxicModel(whole, fit(features(found["sum"].to_numpy(float), found["words"].to_numpy(float)), y, importance))


def score_column(model: ToxicModel, text_col: str = "text") -> Column:
    """The score of a whole text, from 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return score(doc_text(text_col))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` less what is taken for toxic."""
    return docs.where(score_column(train(docs, labels, id_col, text_col), text_col) < THRESHOLD)


def op13_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`."""
    from tessera.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model).alias("score"))
    return rows.select("doc_id", (fold_of(F.col("doc_id")) % 4 == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

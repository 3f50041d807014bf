"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are training rows labelled 1; unlabelled web text is a sample of all training rows, whose
labels are not looked at. The class prior is estimated as the smoothed share of 1 among the labelled training
rows. With g the model, l the logistic loss and prior p, the risk to minimise is

    p E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - p E_P[l(g, -1)])

where a negative second term is not followed: the step then goes back up on it, which keeps a model from fitting
positives as if they were all there is. g is linear in standardised statistics of the whole text; its sigmoid is
the score, as the logistic loss makes it an estimate of the chance of label 1.

Labels, lang, source and ids are no inputs of a score. Both samples are bounded (SAMPLE rows each, the smallest by
a hash of the id), so the model fits in the driver; scores are made for every row in one pass.

Defined cases: a null text counts as empty, and an empty text has a score like any other; a very long text is scored
whole; rows that share an id (ties) give a sample one row, the one with the smallest features; a table without
labelled positives gives the prior 0.5 to every row; null labels are no labels; rows with a null id are never
sampled; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, small_batches

#: Rows of trusted positives, and of unlabelled text, that the model is fitted on at most.
SAMPLE = 20_000
#: Words in a window whose worst value counts, beside the mean over the text.
WINDOW = 200
#: The score from which a document is taken for good.
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)  # 0 letters, 1 capitals, 2 digits, 3 white space, 4 ends of phrases, 5 other ASCII, 6 non-ASCII
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 6 if _b >= 128 else 1 if "A" <= _c <= "Z" else 0 if "a" <= _c <= "z" else 2 if "0" <= _c <= "9" else 3 if _c in " \t\n\r\f\v" else 4 if _c in ".,;:'\"-?()" else 5
_PLAIN = bytes(b if _CLASS[b] in (0, 1, 6) else 32 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """Statistics of one whole text, none of which depends on what the words mean."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return np.concatenate(([1.0], np.zeros(N_FEATURES - 1)))
    shares = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=7) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    odd = np.fromiter((not w.isalpha() for w in [w.rstrip(b".,;:?\n") for w in raw.translate(_ASCII_FOLD).split()]), np.int64)
    capital = np.fromiter((w.isupper() and len(w) > 1 for w in words), np.int64, n)
    same = np.zeros(n, np.int64)
    same[1:] = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), np.int64, n - 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    ends = np.fromiter((w[-1:] in b".!?" for w in words), np.int64, n)
    distinct = len(set(words))
    worst = []
    for flags in (odd, capital, same):
        sums = np.concatenate(([0], flags.cumsum()))
        k = min(WINDOW, len(flags)) or 1
        worst += [flags.mean() if len(flags) else 0.0, (sums[k:] - sums[:-k]).max() / k if len(flags) else 0.0]
    return np.array([
        0.0, np.log1p(n), *shares, lengths.mean(), np.log1p(lengths.max()), lengths.std(), *worst, distinct / n, np.log(distinct) / np.log1p(n),
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), ends.mean(), len(zlib.compress(raw, 1)) / size, raw.count(b"http") / n * 10, raw.count(b"@") / n * 10,
    ])


_ASCII_FOLD = bytes(97 if b >= 128 else b for b in range(256))  # so that isalpha() of bytes takes non-ASCII letters for letters
N_FEATURES = 26


@dataclass
class PuModel:
    """A linear model of standardised features; without weights, the prior for every row."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def expand(self, x: np.ndarray) -> np.ndarray:
        """Standardised features, what exceeds two deviations to either side, and one."""
        z = np.clip((x - self.mean) / self.scale, -12, 12)
        return np.hstack([z, np.maximum(z - 2, 0), np.maximum(-z - 2, 0), np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights, -30, 30)))


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.02, decay: float = 1e-4) -> PuModel:
    """Minimises the non-negative risk by full-batch Adam; the same input gives the same model."""
    model = PuModel(prior)
    if not len(positives) or not len(unlabelled):
        return model
    middle = np.median(positives, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(positives - middle), axis=0), positives.std(axis=0) * 0.25)
    model.mean, model.scale = middle, np.where(spread > 1e-9, spread, 1.0)
    xp, xu = model.expand(positives), model.expand(unlabelled)
    w, m, v = np.zeros(xp.shape[1]), np.zeros(xp.shape[1]), np.zeros(xp.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for step in range(1, steps + 1):
        gp, gu = xp @ w, xu @ w
        sp, su = sigmoid(gp), sigmoid(gu)
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_negative = xu.T @ su / len(xu) - prior * (xp.T @ sp) / len(xp)
        grad = prior * (xp.T @ (sp - 1)) / len(xp) + d_negative if negative >= 0 else -d_negative
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.weights = w
    return model


def fold(id_col: Column) -> Column:
    """crc32 of the id as text; its remainders deal rows into folds."""
    return F.crc32(id_col.cast("string").cast("binary"))


def _matrices(docs: DataFrame, samples: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the trusted positives and of the unlabelled rows, in the order of their ids, from one scan.

    `samples` (the_id, trusted, everyone) has at most 2 SAMPLE ids, so it is broadcast. Of rows that share an id one
    counts, the one with the smallest features, whatever the partitioning.
    """

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    rows = docs.select(F.col(id_col).cast("long").alias("the_id"), doc_text(text_col).alias("text")).join(F.broadcast(samples), "the_id")
    rows = rows.select("the_id", "trusted", "everyone", stats("text").alias("x"))
    found = rows.groupBy("the_id", "trusted", "everyone").agg(F.min("x").alias("x")).toPandas().sort_values("the_id", kind="stable")
    matrix = lambda mine: np.array(found["x"][mine].tolist(), dtype=float).reshape(-1, N_FEATURES)
    return matrix(found["trusted"].astype(bool)), matrix(found["everyone"].astype(bool))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, fold_by: int = 5) -> PuModel:
    """Learns from the rows of `docs` outside fold 0; `labels` has the id column and quality."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("the_id"), F.col("quality").cast("int").alias("q")).where(F.col("q").isin(0, 1) & (fold(F.col("the_id")) % fold_by != 0))
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("q"), F.lit(0)).alias("ones")).first()
    prior = (counts.ones + 1) / (counts.n + 2)
    if not counts.ones:
        return PuModel(prior)
    picked = lambda ids, name: ids.distinct().orderBy(F.xxhash64("the_id"), "the_id").limit(sample).withColumn(name, F.lit(True))
    trusted = picked(known.where("q = 1").select("the_id"), "trusted")
    everyone = picked(docs.select(F.col(id_col).cast("long").alias("the_id")).where("the_id IS NOT NULL").where(fold(F.col("the_id")) % fold_by != 0), "everyone")
    samples = trusted.join(everyone, "the_id", "full_outer").select("the_id", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce("everyone", F.lit(False)).alias("everyone"))
    return fit(*_matrices(docs, samples, id_col, text_col), prior)


def score_column(model: PuModel, text_col: str = "text") -> Column:
    """The score of a whole text, from 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, N_FEATURES)))

    return score(doc_text(text_col))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` less what the classifier rejects."""
    return docs.where(score_column(train(docs, labels, id_col, text_col), text_col) >= THRESHOLD)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`."""
    from tessera.sources.tables import table

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model).alias("score"))
    return rows.select("doc_id", (fold(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

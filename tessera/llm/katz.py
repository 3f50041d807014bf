"""Language-model scoring with Katz backoff of any order.

    P(w)     = d(c(w)) c(w) / N for words of the training texts; what the discounts free is the unknown word's
    P(w | h) = d(c(h w)) c(h w) / c(h)    if h w is in the training texts
             = a(h) P(w | h')             else, with a(h) = (1 - sum of the seen P(w | h)) / (1 - sum of their P(w | h'))

where h' is h without its first word. The discounts d are Good-Turing's for counts up to K and 1 above, for each order its
own; a(h) is what makes the probabilities of a context sum to one exactly. A context that the training texts lack has
a(h) = 1; one whose counts are all above K is treated as in `weights`. The end of a text is a token, and the
context of a text's first token; longer contexts do not reach beyond it.

Counting and scoring share one layout. Texts are gathered into blocks of bounded size with a vocabulary of their own. For
each order, from words up, every block sends its distinct n-grams to buckets by their context: a bucket adds up the counts,
numbers the n-grams, and writes two things, a table (contexts, words, counts, numbers and what the backoff weights need) and
for each block the answers to its questions. An n-gram is known to the next order by its number, so a context is one
integer at every order and the recursion is the same step again: a block knows P(w | h') of its tokens from the orders
before and gets from the answers what P(w | h) needs. At last each block has the probability of each of its tokens.

The tables, one folder for each order and partitioned by kind, stay with the model: `KatzModel.score` asks them about other
texts in the same way. A block sends a message to a bucket only if it has n-grams there, so there are at most as many
messages as distinct n-grams in blocks, which grows with the texts.

Contexts with over 1/HEADS of all tokens, of which there are fewer than HEADS, are dealt over all buckets of their order,
and only their sums (one row each) reach the driver; no other bucket gets more than its share. All else that the
driver sees are the counts of counts up to K + 1. Words are known by a 64-bit hash, which is not verified: of V words about
V^2 / 2^65 pairs share one.

Defined cases: a null text counts as empty and has the end token alone; a very long text is a block of its own; a null id is a
training row; without training rows every token is the unknown word, which then has probability 1; repeated rows each
count and are each scored; equal counts (ties) are numbered by hash, which changes no result; an empty table gives no rows;
further columns are ignored. Counts of counts that allow no Good-Turing discount (few data) are replaced by an
absolute discount, see `discounts`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, shared_folder, small_batches, written

#: Counts up to K are discounted.
K = 5
#: Tokens in a block, unless one text alone has more.
BLOCK = 1_500_000
#: Entries that a word or bigram bucket gets from all blocks, about.
BUCKET = 1_500_000
#: A context with over 1/HEADS of all training tokens is dealt over all buckets.
HEADS = 1000
#: A token that no text holds.
END = b"\n"

#: One schema for what meets at a block or a bucket: what it is, of which order, and packed arrays.
PARTS = "block long, kind int, level int, bucket long, ids binary, a binary, b binary, c binary, d binary, e binary"
_COLUMNS = [x.split()[0] for x in PARTS.split(", ")]
_BLOCK, _ASK, _ANSWER, _TABLE, _STATS, _HEADS = range(6)


def pack(x: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(raw: bytes, dtype) -> np.ndarray:
    """The array that was packed."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a whole text: A-Z lowered, cut at spaces and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id, fold_by: int) -> bool:
    """Whether crc32 of the id as text is divisible by fold_by; a null id is not held out."""
    return not pd.isna(doc_id) and zlib.crc32(str(int(doc_id)).encode()) % fold_by == 0


@dataclass(frozen=True)
class Level:
    """Good-Turing discounts of one order: factor[r] for r up to K, and the counts of counts they come from."""

    factor: tuple[float, ...]

    def of(self, counts: np.ndarray) -> np.ndarray:
        """d(r) r for each count."""
        return np.asarray(self.factor)[np.minimum(counts, K + 1)] * counts


def discounts(n: list[float]) -> Level:
    """From n[r], the number of types seen r times (r up to K + 1), Katz's factors for r = 0 ... K + 1.

    A factor outside (0, 1), as few data give, is replaced by (r - b) / r with b = n1 / (n1 + 2 n2), or 1/2 if
    there are no types seen once or twice.
    """
    n = [0.0, *map(float, n)]
    b = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    out = [0.0]
    for r in range(1, K + 1):
        d = math.nan
        if n[1] and n[r]:
            cut = (K + 1) * n[K + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (n[r] * r) - cut) / (1 - cut) if cut != 1 else math.nan
        out.append(d if 0 < d < 1 else (r - b) / r)
    return Level((*out, 1.0))


@dataclass(frozen=True)
class Unigrams:
    """N tokens, V types and the counts of counts of the training texts."""

    n: int
    v: int
    level: Level
    unknown: float
    total: float

    @staticmethod
    def of(n: int, v: int, counts: list[float]) -> Unigrams:
        level = discounts(counts)
        freed = sum((1 - level.factor[r]) * r * counts[r - 1] for r in range(1, K + 1))
        # where nothing is freed, one count more is set aside for the unknown word
        return Unigrams(n, v, level, freed / n if freed else 1 / (n + 1), float(n if freed else n + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by the count of w; of the unknown word for a count of 0."""
        return np.where(counts > 0, self.level.of(counts) / self.total, self.unknown)


def weights(c1: np.ndarray, few: np.ndarray, above: np.ndarray, q: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """The divisor of the seen counts and a(v), by context: c1 its count, few[r - 1] its bigrams seen r times,
    `above` the sum of its counts above K, q the sum of P(w) over its seen w.

    A context never seen backs off with weight 1. One whose counts are all above K frees nothing, so one more
    count is set aside for what it has not been seen with.
    """
    r = np.arange(1, K + 1)
    kept = above + few @ (np.asarray(level.factor)[1 : K + 1] * r)
    divisor = np.where(few.sum(axis=1) > 0, c1, c1 + 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (1 - kept / divisor) / (1 - q)
    return divisor, np.where(c1 > 0, a, 1.0)


def _row(block: int, kind: int, level: int, bucket: int = 0, ids: bytes = b"", a: bytes = b"", b: bytes = b"", c: bytes = b"", d: bytes = b"", e: bytes = b"") -> tuple:
    return block, kind, level, bucket, ids, a, b, c, d, e


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def blocks_of(docs: DataFrame, id_col: str, text_col: str, fold_by: int, size: int) -> DataFrame:
    """PARTS of kind _BLOCK: the ids, lengths (a), tokens as places in the block's vocabulary (b), the vocabulary's hashes
    in their order (c) and its counts in the training texts (d), whether each text is held out, or 2 for a null id (e)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done = TaskContext.get().partitionId(), 0
        vocab: dict[bytes, int] = {END: 0}
        ids: list[int] = []
        doc_ids, lengths, held = [], [], []

        def flush() -> pd.DataFrame:
            tokens, sizes, out_fold = np.array(ids, "<u4"), np.array(lengths, "<u4"), np.array(held, np.uint8)
            counts = np.bincount(tokens[np.repeat(out_fold, sizes) != 1], minlength=len(vocab)).astype("<u4")
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocab), "<u8", len(vocab))
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            return _frame([_row((part << 24) + done, _BLOCK, 1, 0, pack(np.array(doc_ids, "<i8")), pack(sizes), pack(place[tokens]), hashes[order].tobytes(), pack(counts[order]), pack(out_fold))])

        for pdf in batches:
            for d, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = tokens_of(t)
                if lengths and len(ids) + len(words) > size:
                    yield flush()
                    done += 1
                    vocab, ids, doc_ids, lengths, held = {END: 0}, [], [], [], []
                number = vocab.setdefault
                ids += [number(w, len(vocab)) for w in words]
                ids.append(0)
                doc_ids.append(0 if pd.isna(d) else int(d))
                lengths.append(len(words) + 1)
                held.append(2 if pd.isna(d) else int(is_held_out(d, fold_by)))
        if lengths:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))
    return rows.mapInPandas(run, PARTS)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].astype("<i8")


def _stats(level: int, bucket: int, counts: np.ndarray, numbers: np.ndarray) -> tuple:
    """Tokens, types and counts of counts (a), and the heaviest n-grams of a bucket (b, c)."""
    top = np.argsort(-counts, kind="stable")[:HEADS]
    sums = np.concatenate(([counts.sum(), (counts > 0).sum()], _counts_of_counts(counts))).astype("<i8")
    return _row(-1, _STATS, level, bucket, a=sums.tobytes(), b=numbers[top].astype("<i8").tobytes(), c=counts[top].astype("<i8").tobytes())


def _numbers(counts: np.ndarray, buckets: int, bucket: int) -> np.ndarray:
    """Numbers, from 1 and over all buckets without two alike, of what has been counted, small ones for large counts; 0 for the rest."""
    order, out = np.argsort(-counts, kind="stable"), np.empty(len(counts), np.int64)
    out[order] = 1 + np.arange(len(counts)) * buckets + bucket
    return np.where(counts > 0, out, 0)


def ask_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """PARTS of kind _ASK: for a block and word bucket, a range of hashes, the block's hashes there (a) and their counts (d)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                hashes, counts = np.frombuffer(r.c, "<u8"), unpack(r.d, "<u4")
                found, starts = np.unique((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)
                stops = [*starts[1:].tolist(), len(hashes)]
                yield _frame([_row(r.block, _ASK, 1, k, a=hashes[x:y].tobytes(), d=pack(counts[x:y])) for k, x, y in zip(found.tolist(), starts.tolist(), stops, strict=True)])

    return blocks.select("block", "c", "d").mapInPandas(run, PARTS)


def answer_words(buckets: int):
    """A word bucket's table (hashes a, counts b, numbers c), its answers to each block (numbers a, counts b) and its stats.
    Where it is given a table, that answers; else the questions' own counts make one."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(key[0]), []
        asks, told = pdf[pdf["kind"] == _ASK], pdf[pdf["kind"] == _TABLE]
        asked = [np.frombuffer(h, "<u8") for h in asks["a"]]
        if len(told):
            t = told.iloc[0]
            found, counts, numbers = np.frombuffer(t["a"], "<u8"), unpack(t["b"], "<i8"), unpack(t["c"], "<i8")
            at = None
        else:
            found, at = np.unique(np.concatenate(asked), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([unpack(n, "<u4") for n in asks["d"]]), minlength=len(found)).astype("<i8")
            numbers = _numbers(counts, buckets, bucket)
            seen = counts > 0
            out.append(_row(-1, _TABLE, 1, bucket, a=found[seen].tobytes(), b=pack(counts[seen]), c=pack(numbers[seen])))
            out.append(_stats(1, bucket, counts, numbers))
        start = 0
        for block, h in zip(asks["block"], asked, strict=True):
            if at is None:
                place = np.minimum(np.searchsorted(found, h), max(len(found) - 1, 0))
                hit = found[place] == h if len(found) else np.zeros(len(h), bool)
                n, c = (np.where(hit, x[place], 0) if len(found) else np.zeros(len(h), np.int64) for x in (numbers, counts))
            else:
                mine = at[start : start + len(h)]
                start += len(h)
                n, c = numbers[mine], counts[mine]
            out.append(_row(block, _ANSWER, 1, bucket, a=pack(n.astype("<i8")), b=pack(c.astype("<i8"))))
        return _frame(out)

    return run


@dataclass
class Order:
    """What is known of one order from 2 on: its buckets, discounts, and the sums of its contexts that are dealt out."""

    buckets: int
    heads: np.ndarray
    level: Level | None = None
    few: np.ndarray | None = None
    above: np.ndarray | None = None
    q: np.ndarray | None = None


class BlockView:
    """A block and the answers so far: for each token its word's number, and the probability by the highest order known."""

    def __init__(self, pdf: pd.DataFrame, unigrams: Unigrams, orders: dict[int, Order]) -> None:
        block = pdf[pdf["kind"] == _BLOCK].iloc[0]
        self.block, self.ids = int(block["block"]), unpack(block["ids"], "<i8")
        self.lengths, self.tokens, self.held = unpack(block["a"], "<u4").astype(np.int64), unpack(block["b"], "<u4").astype(np.int64), unpack(block["e"], np.uint8)
        answers = pdf[pdf["kind"] == _ANSWER]
        words = answers[answers["level"] == 1].sort_values("bucket")
        number, count = (np.concatenate([unpack(x, "<i8") for x in words[c]]) for c in "ab")
        self.types, self.word, self.count = len(number), number[self.tokens], count[self.tokens]
        self.begins = np.concatenate((np.zeros(1, np.int64), self.lengths.cumsum()[:-1]))
        #: of each token the n-gram of the highest order known that ends there: a number in this block, and its own
        self.local, self.own = self.tokens, self.word
        self.p, self.lower = unigrams.p(self.count), self.count
        for k in sorted(orders):
            rows = answers[answers["level"] == k]
            if len(rows) or orders[k].level is not None:
                self.ask(k, orders[k])
                self.learn(k, orders[k], rows)

    def ask(self, k: int, order: Order) -> None:
        """Finds the block's distinct n-grams of order k: context, word, P or count of the order below, and bucket."""
        context, local = np.zeros(len(self.tokens), np.int64), np.full(len(self.tokens), -1)
        context[1:], local[1:] = self.own[:-1], self.local[:-1]
        end = self.lengths[0] - 1  # the first text's last token
        context[self.begins], local[self.begins] = (self.own[end], self.local[end]) if k == 2 else (0, -1)
        keys, self.first, self.at = np.unique(np.where(local < 0, -1, local * self.types + self.tokens), return_index=True, return_inverse=True)
        self.context = context
        self.g1, self.g2 = context[self.first], self.word[self.first]
        self.is_head = np.isin(self.g1, order.heads)
        # contexts never seen ask nothing
        spread = np.where(self.is_head, self.g1 * 1_000_003 + self.g2 * 7_919, self.g1)
        self.bucket = np.where(self.g1 > 0, spread % order.buckets, -1)
        self.order = np.lexsort((self.g2, self.g1, self.bucket))
        self.sorted_bucket = self.bucket[self.order]

    def of(self, bucket: int) -> np.ndarray:
        """The n-grams of a bucket, by context and word."""
        low, high = np.searchsorted(self.sorted_bucket, [bucket, bucket + 1])
        return self.order[low:high]

    def learn(self, k: int, order: Order, rows: pd.DataFrame) -> None:
        """Takes the answers about order k: P of each token and, for the order above, the numbers of its n-grams."""
        counts, numbers = np.zeros(len(self.g1), np.int64), np.zeros(len(self.g1), np.int64)
        divisor, back = np.ones(len(self.g1)), np.ones(len(self.g1))
        for r in rows.itertuples(index=False):
            mine = self.of(r.bucket)
            counts[mine] = unpack(r.a, "<u4")
            if r.e:
                numbers[mine] = unpack(r.e, "<i8")
            few, above = unpack(r.b, "<u4").reshape(-1, K).astype(np.int64), unpack(r.c, "<i8")
            of = np.unique(self.g1[mine], return_inverse=True)[1]
            found = weights(few @ np.arange(1, K + 1) + above, few, above, unpack(r.d, "<f8"), order.level)
            divisor[mine], back[mine] = found[0][of], found[1][of]
        at = np.flatnonzero(self.is_head)
        if len(at):
            found = weights(order.few @ np.arange(1, K + 1) + order.above, order.few, order.above, order.q, order.level)
            of = np.searchsorted(order.heads, self.g1[at])
            divisor[at], back[at] = found[0][of], found[1][of]
        p = np.where(counts > 0, order.level.of(counts) / divisor, back * self.p[self.first])
        self.p = np.where(self.context > 0, p[self.at], self.p)
        self.own, self.local, self.lower = numbers[self.at], self.at, self.p


def ask_grams(k: int, unigrams: Unigrams, orders: dict[int, Order]):
    """PARTS of kind _ASK: for a block and bucket of order k its n-grams there, by context (a, differences) and word (b), what
    P of the order below comes from (c: the word's count, or P itself) and their counts in the block's training texts (d)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        view = BlockView(pdf, unigrams, {j: o for j, o in orders.items() if j < k})
        view.ask(k, orders[k])
        train = np.repeat(view.held, view.lengths) != 1
        seen, lower = np.bincount(view.at[train], minlength=len(view.g1)), view.lower[view.first]
        out = []
        for b in np.unique(view.sorted_bucket[view.sorted_bucket >= 0]).tolist():
            mine = view.of(b)
            out.append(_row(view.block, _ASK, k, b, a=pack(np.diff(view.g1[mine], prepend=0).astype("<i8")), b=pack(view.g2[mine].astype("<i8")), c=pack(lower[mine]), d=pack(seen[mine].astype("<u4"))))
        return _frame(out)

    return run


def answer_grams(k: int, buckets: int, unigrams: Unigrams, heads: np.ndarray, numbered: bool):
    """A bucket's table of order k (contexts a, words b, counts c, numbers d, sums of P of the order below by context e), its
    answers to each block (counts a; by context the n-grams seen 1 ... K times b, the sum of the counts above c and the sum
    of P d; numbers e), its share of the contexts that are dealt out (b, c, d; e: their numbers), and its stats."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, out = int(key[0]), []
        asks, told = pdf[pdf["kind"] == _ASK], pdf[pdf["kind"] == _TABLE]
        firsts = [unpack(a, "<i8").cumsum() for a in asks["a"]]
        g1, g2 = firsts, [unpack(b, "<i8") for b in asks["b"]]
        known = 0
        if len(told):
            t = told.iloc[0]
            table = unpack(t["a"], "<i8").cumsum(), unpack(t["b"], "<i8")
            known, g1, g2 = len(table[0]), [table[0], *g1], [table[1], *g2]
        g1, g2 = np.concatenate(g1), np.concatenate(g2)
        order = np.lexsort((g2, g1))
        s1, s2 = g1[order], g2[order]
        new = np.ones(len(order), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        at = np.empty(len(order), np.int64)
        at[order] = new.cumsum() - 1
        k1, k2 = s1[new], s2[new]
        contexts, of = np.unique(k1, return_inverse=True)
        at, mine = at[known:], at[:known]
        counts, numbers, q = np.zeros(len(k1), np.int64), np.zeros(len(k1), np.int64), np.zeros(len(contexts))
        if len(told):
            counts[mine] = unpack(t["c"], "<i8")
            if numbered:
                numbers[mine] = unpack(t["d"], "<i8")
            q[np.unique(of[mine])] = unpack(t["e"], "<f8")
        else:
            counts = np.bincount(at, weights=np.concatenate([unpack(d, "<u4") for d in asks["d"]]), minlength=len(k1)).astype(np.int64)
            lower = np.zeros(len(k1))
            sent = np.concatenate([unpack(c, "<i8" if k == 2 else "<f8") for c in asks["c"]])
            lower[at] = unigrams.p(sent) if k == 2 else sent
            seen = counts > 0
            q = np.bincount(of[seen], weights=lower[seen], minlength=len(contexts))
            if numbered:
                numbers = _numbers(counts, buckets, bucket)
            own = np.unique(of[seen])
            out.append(_row(-1, _TABLE, k, bucket, a=pack(np.diff(k1[seen], prepend=0).astype("<i8")), b=pack(k2[seen].astype("<i8")), c=pack(counts[seen].astype("<i8")), d=pack(numbers[seen].astype("<i8")) if numbered else b"", e=pack(q[own])))
            out.append(_stats(k, bucket, counts, numbers))
        above = np.bincount(of, weights=np.where(counts > K, counts, 0), minlength=len(contexts)).astype("<i8")
        few = np.bincount(of * (K + 2) + np.minimum(counts, K + 1), minlength=len(contexts) * (K + 2)).reshape(-1, K + 2)[:, 1 : K + 1].astype("<u4")
        start = 0
        for block, g in zip(asks["block"], firsts, strict=True):
            here, some = at[start : start + len(g)], np.searchsorted(contexts, np.unique(g))
            start += len(g)
            out.append(_row(block, _ANSWER, k, bucket, a=pack(counts[here].astype("<u4")), b=pack(few[some].ravel()), c=pack(above[some]), d=pack(q[some]), e=pack(numbers[here].astype("<i8")) if numbered else b""))
        some = np.flatnonzero(np.isin(contexts, heads))
        if len(some) and not len(told):
            out.append(_row(-1, _HEADS, k, bucket, b=few[some].astype("<i8").tobytes(), c=above[some].tobytes(), d=q[some].tobytes(), e=contexts[some].astype("<i8").tobytes()))
        return _frame(out)

    return run


def _sum_rows(rows: DataFrame) -> np.ndarray:
    """The sum of the small arrays in column a of the stats; one row for each bucket, summed by the executors."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                total = np.sum([np.frombuffer(a, "<i8") for a in pdf["a"]], axis=0)
                yield pd.DataFrame({"i": np.arange(len(total)), "x": total})

    found = rows.where(F.col("kind") == _STATS).select("a").mapInPandas(add, "i long, x long").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()
    return np.array([r.x for r in found], np.int64)


def _heads(rows: DataFrame, n: int) -> np.ndarray:
    """Numbers of the n-grams with over n / HEADS tokens, fewer than HEADS."""

    def heavy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b, c in zip(pdf["b"], pdf["c"], strict=True):
                number, count = np.frombuffer(b, "<i8"), np.frombuffer(c, "<i8")
                yield pd.DataFrame({"g": number, "c": count})[(count * HEADS > n) & (number > 0)]

    found = rows.where(F.col("kind") == _STATS).select("b", "c").mapInPandas(heavy, "g long, c long").orderBy("g").limit(HEADS).collect()
    return np.array([r.g for r in found], np.int64)


def _head_sums(rows: DataFrame, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """few, above and q of the contexts that are dealt out, over all buckets."""
    columns = [f"x{i}" for i in range(K + 2)]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                few = np.frombuffer(r.b, "<i8").reshape(-1, K)
                values = np.column_stack([few, np.frombuffer(r.c, "<i8"), np.frombuffer(r.d, "<f8")])
                yield pd.DataFrame(values, columns=columns).assign(g=np.frombuffer(r.e, "<i8"))

    found = rows.where(F.col("kind") == _HEADS).select("b", "c", "d", "e").mapInPandas(sums, ", ".join(f"{c} double" for c in columns) + ", g long")
    summed = {r.g: [r[c] for c in columns] for r in found.groupBy("g").agg(*(F.sum(c).alias(c) for c in columns)).limit(HEADS).collect()}
    table = np.array([summed.get(int(g), [0.0] * (K + 2)) for g in heads]).reshape(-1, K + 2)
    return table[:, :K], table[:, K], table[:, K + 1]


def _sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words in the vocabulary and tokens of each block."""
    for pdf in batches:
        yield pd.DataFrame({"words": [len(c) // 8 for c in pdf["c"]], "tokens": [int(unpack(a, "<u4").sum(dtype=np.int64)) for a in pdf["a"]]})


class KatzModel:
    """A backoff model in tables: one for each order, of packed arrays by bucket, beside the few numbers of the driver."""

    def __init__(self, order: int = 2, fold_by: int = 10, block: int = BLOCK, bucket: int = BUCKET) -> None:
        if order < 2:
            raise ValueError("the order is 2 or more")
        self.order, self.fold_by, self.block, self.bucket = order, fold_by, block, bucket
        self.word_buckets, self.unigrams, self.orders = 1, None, {}
        self.tables: dict[int, DataFrame] = {}

    def fit_score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Learns from the rows of `docs` that are not held out; the scores of all of them."""
        return self._run(docs, id_col, text_col, True)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The scores of other texts, by the tables; nothing is learned from them."""
        if self.unigrams is None:
            raise ValueError("the model has not been fitted")
        return self._run(docs, id_col, text_col, False)

    def _run(self, docs: DataFrame, id_col: str, text_col: str, fit: bool) -> DataFrame:
        small_batches(docs.sparkSession)
        folder = shared_folder(docs.sparkSession)
        blocks = written(blocks_of(docs, id_col, text_col, self.fold_by, self.block), folder, "blocks")
        if fit:
            sizes = blocks.select("c", "a").mapInPandas(_sizes, "words long, tokens long").agg(F.sum("words").alias("words"), F.sum("tokens").alias("tokens")).first()
            self.word_buckets = max(1, math.ceil((sizes.words or 0) / self.bucket))
        told = self._told(ask_words(blocks, self.word_buckets), answer_words(self.word_buckets), folder, 1, fit)
        if fit:
            stats = _sum_rows(told)
            n, v, counts = (int(stats[0]), int(stats[1]), [float(x) for x in stats[2:]]) if len(stats) else (0, 0, [0.0] * (K + 1))
            self.unigrams = Unigrams.of(n, v, counts) if n else Unigrams(0, 0, discounts([0.0] * (K + 1)), 1.0, 1.0)
        # what a block needs from here on is not its hashes
        met = blocks.select("block", "kind", "level", "bucket", "ids", "a", "b", F.lit(b"").alias("c"), F.lit(b"").alias("d"), "e")
        met = met.unionByName(told.where(F.col("kind") == _ANSWER))
        for k in range(2, self.order + 1):
            if fit:
                self.orders[k] = Order(max(1, math.ceil((sizes.tokens or 0) / self.bucket)), _heads(told, self.unigrams.n))
            order, unigrams = self.orders[k], self.unigrams
            asked = met.groupBy("block").applyInPandas(ask_grams(k, unigrams, dict(self.orders)), PARTS)
            told = self._told(asked, answer_grams(k, order.buckets, unigrams, order.heads, k < self.order), folder, k, fit)
            if fit:
                stats = _sum_rows(told)
                order.level = discounts([float(x) for x in stats[2:]] if len(stats) else [0.0] * (K + 1))
                order.few, order.above, order.q = _head_sums(told, order.heads)
            met = met.unionByName(told.where(F.col("kind") == _ANSWER))
        unigrams, orders = self.unigrams, dict(self.orders)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            view = BlockView(pdf, unigrams, orders)
            base = np.log10((view.count + 0.1) / (unigrams.n + 0.1 * (unigrams.v + 1)))
            total = lambda x: np.add.reduceat(x, view.begins)
            return pd.DataFrame({
                "doc_id": pd.arrays.IntegerArray(view.ids, view.held == 2), "held_out": view.held == 1, "n_tokens": view.lengths, "n_known": total((view.count > 0).astype(np.int64)),
                "train_tokens": unigrams.n, "base_score": total(base), "score": total(np.log10(view.p)),
            })

        return met.groupBy("block").applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

    def _told(self, asked: DataFrame, answer, folder: str, level: int, fit: bool) -> DataFrame:
        """What the buckets of an order say, written by kind; their tables stay with the model when it is fitted."""
        rows = asked if fit else asked.unionByName(self.tables[level])
        said = rows.groupBy("bucket").applyInPandas(answer, PARTS)
        path = f"{folder}/order-{level}"
        said.write.options(compression="zstd").partitionBy("kind").parquet(path)
        told = asked.sparkSession.read.schema(said.schema).parquet(path).select(*_COLUMNS)
        if fit:
            self.tables[level] = told.where(F.col("kind") == _TABLE)
        return told


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold_by: int = 10, block: int = BLOCK, bucket: int = BUCKET, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; learns from the rows that
    are not held out."""
    return KatzModel(order, fold_by, block, bucket).fit_score(docs, id_col, text_col)


def op8_katz(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`."""
    from tessera.sources.tables import table

    return score(table(spark, sf_dir, "documents"))

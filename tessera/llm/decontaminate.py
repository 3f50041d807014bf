"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

A document is contaminated by an item if one of its runs of words, of whatever length, is within SHARE of the item's
length in edit distance over words; so a passage counts with words added or left out, and one that the text's start or
end cuts off counts while what is missing is within the limit. Items of fewer than MIN_WORDS words, common phrases
often, count as exact copies only.

The CGK embedding walks over a string with a random bit for each step and word: the output of a step is the word under
the pointer, which then moves on by the bit, and past the end it is a filler. Strings at a small edit distance fall
back into step after an edit, so their outputs differ in few places, and words sampled from the outputs make LSH keys
that agree with good chance. A walk has STEPS steps a word, so that it covers the string. Half of the WALKS go
backwards from the end, so that edits near the start and near the end alike leave a long part in step. WALKS walks
with KEYS keys of KEY_WORDS sampled words each take the chance that no window of a passage shares a key to the target
recall, over 0.99 wherever its edits sit (`expected_recall`; measured in the tests and the README). What shares a key
is verified by the exact edit distance, that to the closest run of words near the window, so nothing is reported
wrongly.

Every word position of every document starts a window, also those that a text's start or end cuts off. Windows as
long as the item, and only those that can be within the limit, are embedded: of an item's r words that occur in at
most t items, a text within k edits has at least r - k, for every t, also in the window; and of its n - 1 pairs of
neighbours at most 2k are not there. As walks over long strings with many edits drift
apart, an item of over SEGMENT words is cut into segments, each with windows of its own: of a passage within the limit
at least one segment is within its share of it. Segments of one length are searched together, so a block has at most
SEGMENT + MIN_WORDS such searches, however many items it has.

The benchmark is taken in blocks of up to BLOCK items and BLOCK_WORDS words; the index of one block at a time is sent to
the workers. It takes about 2 KB an item and 100 bytes a word, so its size is bounded however many and however long
the items are.

Defined cases: a null text counts as empty; documents and items without words match nothing; a very long text is
searched whole, CHUNK words or one text at once, and a very long item has a longer walk; an item with a null id is
looked for and reported with a null item_id; equal items each match (ties), repeated documents are each reported; of
equally close runs the first to end counts; empty tables give no rows; further columns are ignored. Words are as in
the license scan: runs of digits, letters (A-Z lowered) and non-ASCII characters, so punctuation and layout do not
count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import doc_text, shared_folder, small_batches, written

#: Edits per word of an item up to which a run of words counts: a similarity of 0.8.
SHARE = 0.2
#: Items with fewer words count as exact copies only.
MIN_WORDS = 8
#: Walks, half of them backwards, sampled keys of each, words in a key, and steps of a walk for each word.
WALKS, KEYS, KEY_WORDS, STEPS = 8, 16, 3, 1.5
#: Bits of the hash by which pairs of neighbours are known.
PAIR_BITS = 22
#: Words in a segment of an item at most.
SEGMENT = 64
#: Items and words in a block.
BLOCK, BLOCK_WORDS = 5_000, 1_000_000
#: Numbers of items up to which a word of the benchmark counts as rare, from the rarest words to all of them.
TIERS = (1, 2, 4, 8, 16, 1 << 30)
#: Words searched, and windows embedded, at once.
CHUNK, WINDOWS = 400_000, 20_000

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split(b" ")


def split_words(text: str | None) -> list[bytes]:
    """Words without the empty ones between separators."""
    return [w for w in words_of(text) if w]


def edits(a: list[int], b: list[int], most: int) -> int:
    """The edit distance of two word lists, or most + 1 if it is larger (bit-parallel, any length)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a:
        return len(b)
    at: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = mask, 0, len(a)
    for x in b:
        eq = at.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & mask, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & mask, mh << 1 & mask
        plus, minus = mh | ~(xv | ph) & mask, ph & xv
    return min(score, most + 1)


def closest_span(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """(edits, start) of the run of words of `text` that is closest to the item, or None if that takes over `most` edits.

    Of equally close runs the first to end counts, and of those that end there the one nearest to the item's length.
    """
    if len(text) < len(item) - most:
        return None
    n, at = len(item), defaultdict(int)
    for i, x in enumerate(item):
        at[x] |= 1 << i
    mask, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best, stop = mask, 0, n, most + 1, 0
    for j, x in enumerate(text, 1):  # as in `edits`, but a run may start at any word at no cost
        eq = at.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & mask, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & mask, mh << 1 & mask
        plus, minus = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, stop = score, j
    if best > most:
        return None
    starts = sorted(range(max(0, stop - n - best), min(stop, max(0, stop - n + best)) + 1), key=lambda s: abs(stop - s - n))
    return best, next(s for s in starts if edits(item, text[s:stop], best) == best)


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit numbers whose high bits depend on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ItemIndex:
    """LSH keys of a block of items, and the search of texts for them."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], share: float = SHARE, min_words: int = MIN_WORDS, seed: int = 7) -> None:
        items = [(i, w) for i, w in items if w]
        found_in = Counter(w for _, ws in items for w in set(ws))
        self.vocab = {w: k for k, w in enumerate(sorted(found_in))}
        self.other = len(self.vocab)  # stands for every word of no item
        self.spread = np.array([found_in[w] for w in sorted(found_in)] + [1 << 40])
        self.items = [(i, np.array([self.vocab[w] for w in ws], np.int64)) for i, ws in items]
        self.sizes = np.array([len(ids) for _, ids in self.items], np.int64)
        self.most = np.where(self.sizes < min_words, 0, (share * self.sizes).astype(np.int64))
        #: needs[tier, item]: the rare words that a text within the limit has at least
        self.needs = np.array([[int((self.spread[ids] <= t).sum()) for _, ids in self.items] for t in TIERS], np.int64).reshape(len(TIERS), -1) - self.most
        rng = np.random.default_rng(seed)
        #: a random number for each word and the filler; with a step's number it gives the bit of the step and the word
        self.numbers = rng.integers(0, 1 << 64, self.other + 2, np.uint64)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, ids in self.items:
            self.pairs[self._pairs(ids)] = True
        #: segments: item, offset, length and edits to spare
        cuts = [(m, np.linspace(0, n, -(-n // SEGMENT) + 1).astype(int)) for m, n in enumerate(self.sizes.tolist())]
        self.seg = np.array([(m, a, b - a, 0 if self.most[m] == 0 else int(share * (b - a))) for m, cut in cuts for a, b in zip(cut, cut[1:])], np.int64).reshape(-1, 4).T
        #: a number for each walk and step
        self.steps = rng.integers(0, 1 << 64, (WALKS, int(STEPS * self.seg[2].max(initial=1))), np.uint64) | np.uint64(1)
        self.groups = []
        # of a length, those that must be whole stay apart from those with edits to spare
        for size, k in sorted(set(zip(*self.seg[2:].tolist(), strict=True))):
            self.groups.append(self._group(np.flatnonzero((self.seg[2] == size) & (self.seg[3] == k)), rng))

    def _pairs(self, ids: np.ndarray) -> np.ndarray:
        """The hashes of all pairs of neighbours."""
        numbers = self.numbers[ids]
        return _mix(numbers[:-1] * np.uint64(3) + numbers[1:]) >> np.uint64(64 - PAIR_BITS)

    def _group(self, members: np.ndarray, rng: np.random.Generator) -> tuple:
        """Of segments of one length: their length, edits, least counts, and by walk its steps' numbers and its keys with
        their segments."""
        (item, offset), (size, k) = self.seg[:2, members], self.seg[2:, members[0]].tolist()
        words = np.stack([self.items[m][1][a : a + size] for m, a in zip(item, offset, strict=True)])
        flat, stop = words.ravel(), size * np.arange(1, len(members) + 1)
        needs = np.array([(self.spread[words] <= t).sum(axis=1) for t in TIERS]) - k
        walks, last = [], max(int(STEPS * size), 1)  # of each walk: the steps of its keys, the keys and their segments
        for w in range(WALKS):
            outputs = self._walk(flat, stop - size, stop, w, last)
            picked = np.sort(np.stack([rng.choice(last, min(KEY_WORDS, last), replace=False) for _ in range(KEYS)]), axis=1)
            real = np.any(outputs[picked] != self.other + 1, axis=1)  # not filler alone
            keys, owners = self._keys(outputs[picked])[real], np.broadcast_to(members, real.shape)[real]
            at = np.argsort(keys, kind="stable")
            walks.append((picked, keys[at], owners[at]))
        return size, k, needs.min(axis=1), walks

    def _walk(self, ids: np.ndarray, low: np.ndarray, high: np.ndarray, walk: int, steps: int) -> np.ndarray:
        """The outputs of a walk's first steps, a row for each, over each window ids[low:high]."""
        out, backwards = np.empty((steps, len(low)), np.int32), walk % 2 == 1
        at = high - 1 if backwards else low.copy()
        for step in range(steps):
            word = ids[np.minimum(at, len(ids) - 1)]
            np.putmask(word, (at < low) if backwards else (at >= high), self.other + 1)
            out[step] = word
            bit = (self.numbers[word] * self.steps[walk, step] >> np.uint64(63)).astype(np.int64)
            at = np.maximum(at - bit, low - 1) if backwards else np.minimum(at + bit, high)
        return out

    def _keys(self, outputs: np.ndarray) -> np.ndarray:
        """A hash for each key and window of outputs (key, word, window)."""
        keys = np.repeat(np.arange(1, len(outputs) + 1, dtype=np.uint64)[:, None], outputs.shape[2], axis=1)
        for x in range(outputs.shape[1]):
            keys = _mix(keys * np.uint64(3) + self.numbers[outputs[:, x]])
        return keys

    def search(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item id, start word, words, edits): the closest run of words for each item in each text."""
        out, some, size = [], [], 0
        for t, words in enumerate(texts):
            some.append((t, words))
            size += len(words)
            if size >= CHUNK:
                out += self._search(some)
                some, size = [], 0
        return out + self._search(some)

    def _search(self, texts: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, int, int, int]]:
        get, other = self.vocab.get, self.other
        gap = int(self.seg[3].max(initial=0))
        filler = [other + 1] * gap  # before each text, so that windows may begin before it
        lengths = np.array([gap + len(words) for _, words in texts], np.int64)
        flat: list[int] = []
        for _, words in texts:
            flat += filler
            flat += map(get, words, repeat(other))
        ids = np.array(flat, np.int64)
        if not self.groups or not len(ids):
            return []
        stops = lengths.cumsum()
        begins = stops - lengths + gap
        owner = np.repeat(np.arange(len(texts)), lengths)
        spread = np.append(self.spread, 1 << 40)[ids]
        counts = [np.concatenate(([0], (spread <= t).cumsum())) for t in TIERS]
        pairs = np.concatenate(([0], self.pairs[self._pairs(ids)].cumsum(), [0]))  # pairs[i]: known ones that begin before i
        pairs[-1] = pairs[-2]
        starts = [self._windows(owner, begins, stops, counts, pairs, group) for group in self.groups]
        first, group = np.concatenate(starts), np.repeat(np.arange(len(starts)), [len(x) for x in starts])
        places = []
        for at in range(0, len(first), WINDOWS):
            places += self._candidates(ids, first[at : at + WINDOWS], group[at : at + WINDOWS], owner, begins, stops, counts)
        if not places:
            return []
        place = np.unique(np.concatenate(places, axis=1), axis=1)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        # places of an item that meet are searched as one
        new = np.ones(place.shape[1], bool)
        new[1:] = (place[:2, 1:] != place[:2, :-1]).any(axis=0) | (place[2, 1:] > place[3, :-1])
        heads = np.flatnonzero(new)
        for o, item, low, high in zip(*place[:3, heads].tolist(), np.maximum.reduceat(place[3], heads).tolist() if len(heads) else (), strict=True):
            at, words = (o, item), self.items[item][1].tolist()
            most = best[at][0] - 1 if at in best else int(self.most[item])
            if most >= 0 and (found := closest_span(words, ids[low:high].tolist(), most)):
                best[at] = (found[0], low + found[1])
        return [(texts[o][0], self.items[i][0], s - int(begins[o]), len(self.items[i][1]), d) for (o, i), (d, s) in sorted(best.items())]

    def _windows(self, owner: np.ndarray, begins: np.ndarray, stops: np.ndarray, counts: list[np.ndarray], pairs: np.ndarray, group: tuple) -> np.ndarray:
        """Starts of the group's windows that can be within the limit: a run with k edits that begins, or ends, with a
        window has all but k of the segment's words inside it, as each word that it is longer is an edit."""
        size, k, needs, _ = group
        total, ahead = len(owner), min(size - 1, len(owner))
        if size - 1 > 2 * k:
            high = np.concatenate((pairs[ahead:], np.full(ahead, pairs[-1])))[:total]
            first = np.flatnonzero(high - pairs[:total] >= size - 1 - 2 * k)
        else:
            first = np.arange(total)
        begin, stop = begins[owner[first]], stops[owner[first]]
        first = first[(begin - first <= k) & (stop - first >= size - k)]
        for count, need in zip(counts, needs.tolist(), strict=True):
            begin, stop = begins[owner[first]], stops[owner[first]]
            first = first[count[np.minimum(first + size, stop)] - count[np.maximum(first, begin)] >= need]
        return first

    def _candidates(self, ids: np.ndarray, first: np.ndarray, group: np.ndarray, owner: np.ndarray, begins: np.ndarray, stops: np.ndarray, counts: list[np.ndarray]) -> list[np.ndarray]:
        """(text, item, low, high) of the places where a window, of the groups in their order, shares a key with an item
        and has enough of its words."""
        out, text = [], owner[first]
        begin, stop = begins[text], stops[text]
        sizes = np.array([size for size, *_ in self.groups])
        low, high = np.maximum(first, begin), np.minimum(first + sizes[group], stop)
        present = np.unique(group)
        for w in range(WALKS):
            outputs = self._walk(ids, low, high, w, max(int(STEPS * sizes[present[-1]]), 1))
            for g in present:
                a, b = np.searchsorted(group, [g, g + 1])
                picked, keys, members = self.groups[g][3][w]
                mine = self._keys(outputs[picked, a:b]).ravel()
                left = np.searchsorted(keys, mine)
                at = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == mine)
                if not len(at):
                    continue
                times = np.searchsorted(keys, mine[at], "right") - left[at]
                part = times.cumsum() // CHUNK  # a key of many items that comes often is taken in parts
                for x in range(int(part[-1]) + 1):
                    hit, n = at[part == x], times[part == x]
                    item, offset, length, _ = self.seg[:, members[np.repeat(left[hit] - n.cumsum() + n, n) + np.arange(n.sum())]]
                    hit = a + np.repeat(hit % (b - a), n)
                    # where the whole item can lie around its segment
                    most, rest = self.most[item], self.sizes[item] - offset - length
                    lows, highs = np.maximum(first[hit] - offset - most, begin[hit]), np.minimum(first[hit] + length + rest + most, stop[hit])
                    fits = np.ones(len(hit), bool)
                    for t, count in enumerate(counts):
                        fits &= count[highs] - count[lows] >= self.needs[t][item]
                    out.append(np.unique(np.stack((text[hit], item, lows, highs))[:, fits], axis=1))
        return out


def expected_recall(n: int, k: int, trials: int = 400, seed: int = 3, places: str = "anywhere") -> float:
    """Of random items of n words put into texts with k random edits, k within the limit, the share found; the edits sit
    anywhere, or next to each other at the "front", "middle" or "end"."""
    rng, items, texts = np.random.default_rng(seed), [], []
    start = {"front": 0, "middle": (n - k) // 2, "end": n - k}.get(places)
    for _ in range(trials):
        items.append([b"w%d" % x for x in rng.integers(0, 100_000, n)])
        text = list(items[-1])
        for i in range(k):
            at, kind = int(rng.integers(0, len(text))) if start is None else min(start + i, len(text)), int(rng.integers(0, 3))
            text[at : at + (kind != 1)] = [] if kind == 2 else [b"v%d" % rng.integers(0, 10_000)]
        around = [b"x%d" % x for x in rng.integers(0, 10_000, n)]
        texts.append(around + text + around)
    found = ItemIndex(list(enumerate(items)), seed=seed).search(texts)
    return sum(t == i for t, i, *_ in found) / trials


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """The items in blocks, one of which the driver holds at a time."""
    some: list[tuple[int | None, list[bytes]]] = []
    words = 0
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), doc_text(text_col).alias("t")).toLocalIterator():
        some.append((r.i, split_words(r.t)))
        words += len(some[-1][1])
        if len(some) == block or words >= BLOCK_WORDS:
            yield some
            some, words = [], 0
    if some:
        yield some


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start_word, n_words, edits, similarity: the closest run of words for each item in each document.

    n_words is the item's number of words and similarity the share of it that is not edits; start_word is where the run
    begins. With more than one block of items the blocks are searched one after the other and their results written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_id long, start_word long, n_words long, edits long"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text"))

    def found(sent) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = sent.value
            for pdf in batches:
                hits = index.search(list(map(split_words, pdf["text"])))
                ids = pd.array([hit[1] for hit in hits], dtype="Int64")
                frame = pd.DataFrame([(t, s, n, d) for t, _, s, n, d in hits], columns=["row", "start_word", "n_words", "edits"], dtype="int64")
                frame.insert(1, "item_id", ids)
                frame.insert(0, "doc_id", pdf["doc_id"].array[frame.pop("row").to_numpy()])
                yield frame

        return rows.mapInPandas(run, schema)

    out, folder, last = None, None, None
    for i, items in enumerate(_blocks(benchmark, item_col, item_text, block)):
        if last is not None:  # its result is written before the next block's index is sent
            folder = folder or shared_folder(spark)
            part = written(found(last), folder, f"block-{i}")
            out = part if out is None else out.unionByName(part)
            last.destroy()
        last = spark.sparkContext.broadcast(ItemIndex(items))
    if last is None:
        return spark.createDataFrame([], f"{schema}, similarity double")
    out = found(last) if out is None else out.unionByName(found(last))
    return out.withColumn("similarity", 1 - F.col("edits") / F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """`docs` less the documents that hold a benchmark item; of rows that share an id, only those that do. With more than
    one block of items, what a block leaves is written for the next one."""
    spark = docs.sparkSession
    small_batches(spark)

    def left(docs: DataFrame, sent) -> DataFrame:
        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            found = np.ones(len(texts), bool)
            found[[hit[0] for hit in sent.value.search(list(map(split_words, texts)))]] = False
            return pd.Series(found)

        return docs.where(clean(doc_text(text_col)))

    folder, last = None, None
    for i, items in enumerate(_blocks(benchmark, "item_id", "text", block)):
        if last is not None:
            folder = folder or shared_folder(spark)
            docs = written(left(docs, last), folder, f"left-{i}")
            last.destroy()
        last = spark.sparkContext.broadcast(ItemIndex(items))
    return docs if last is None else left(docs, last)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contaminated documents of all of `documents`, with the items of `benchmark` that they hold."""
    from tessera.sources.tables import table

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

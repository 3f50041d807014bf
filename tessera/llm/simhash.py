"""SimHash near-duplicates with pigeonring candidate pruning.

A fingerprint has 64 bits, split into four segments of 16 that form a ring. If two fingerprints differ in at
most 3 bits there is a segment from which every chain of c consecutive segments differs in at most 3c/4 bits:
none in the first, 1 in the first two, 2 in the first three, 3 in all. The first two segments of the chain are
an exact join key: a fingerprint emits its own key and, when the second segment has an even number of ones,
also the keys with one bit of that segment turned (of two segments that differ in one bit, exactly one is even).
Pairs that share a key are pruned by the rest of the chain and then checked in full.

Copies share a fingerprint, so only distinct fingerprints take part. A key shared by over SMALL fingerprints is
not expanded into pairs: its fingerprints are dealt into blocks, and each pair of blocks, in a task of bounded
size, gives the links of a spanning forest, which connect whatever all the pairs would connect.

`near_dedup` has one fingerprint over word shingles, which small edits move by up to 11 bits at a similarity of 0.8.
`near_copies` reaches such pairs with the same pruning: ROUNDS fingerprints of independent hashes over the words of a
text, each word with a weight that grows with the logarithm of its count, make candidate groups: of two texts that share 0.8 of
their five-word shingles, those of one round or another differ in 3 bits or fewer for over nine pairs in ten. Texts of one
language can be that close without a common shingle, so a group says nothing yet: inside it, the sets of
shingles decide, exactly, in blocks of bounded size.

Defined cases: a null text counts as empty; a text without words has fingerprint zero; fewer words than a
shingle make one shingle; a very long text is hashed in slices; repeated rows and equal fingerprints (ties) are in one
group; an empty table gives no rows; a null id is never a component's name unless all ids of it are null. Further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, apply_decisions, doc_text, lookup, remove, shared_folder, small_batches, written

SEGMENTS, WIDTH, MAX_BITS = 4, 16, 3
#: Fingerprints under one key up to which the pairs are compared in the plan, and those in a block beyond.
SMALL, BLOCK = 16, 2048
#: Fingerprints of a text in `near_copies`.
ROUNDS = 4
#: Words of a shingle in `near_copies`, and its similarity, (PARTS - 1) of PARTS.
WORDS, PARTS = 5, 5
SIMILAR = (PARTS - 1) / PARTS
#: Shingles of a candidate group's block, about.
SHINGLES = 1 << 20
#: Shingles hashed at once, which bounds the memory that a very long text takes.
SLICE = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of one text over its word shingles (XXH64 with seed 42, repeats count)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and \x20 and \x09-\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.fromiter(map(len, words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    begin, stop = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(begin[at : at + SLICE], stop[at : at + SLICE], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fp_column(text_col: str = "text", shingle: int = 3) -> Column:
    """The fingerprint of a text as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fp(doc_text(text_col))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp for every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fp_column(text_col, shingle).alias("fp"))


#: An odd number for each round, by which a word's hash is multiplied.
_ROUND = np.random.default_rng(11).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


def word_fingerprints(text: str | None, rounds: int = ROUNDS) -> np.ndarray:
    """The SimHashes of one text over its words (A-Z lowered), each weighed by 1 + log2 of its count."""
    counts = Counter((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not counts:
        return np.zeros(rounds, np.int64)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 42) for w in counts), np.uint64, len(counts))
    weight = 1 + np.log2(np.fromiter(counts.values(), np.float64, len(counts)))
    ones, half = np.zeros((rounds, 64)), weight.sum() / 2
    for at in range(0, len(hashes), SLICE):
        mixed = hashes[at : at + SLICE] * _ROUND[:rounds, None]
        mixed = (mixed ^ mixed >> np.uint64(32)) * _ROUND[:rounds, None]
        mixed ^= mixed >> np.uint64(29)
        bits = np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(rounds, -1, 8), axis=2, bitorder="little")
        ones += np.einsum("w,rwb->rb", weight[at : at + SLICE], bits)
    return np.packbits(ones > half, axis=1, bitorder="little").view("<i8").ravel()


def words_column(text_col: str = "text", rounds: int = ROUNDS) -> Column:
    """fps, n_words: the fingerprints of a text's words as an array of signed longs, and the number of words."""

    @F.pandas_udf("fps array<long>, n_words long")
    def fps(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"fps": [word_fingerprints(t, rounds) for t in texts], "n_words": [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]})

    return fps(doc_text(text_col))


def chain_keys(distinct: DataFrame) -> DataFrame:
    """key, fp: for each start of the ring the first two segments of the chain, the second also within one bit."""
    parts = []
    for i in range(SEGMENTS):
        own = f"(shiftrightunsigned(fp, {WIDTH * i}) & 65535L)"
        then = f"(shiftrightunsigned(fp, {WIDTH * ((i + 1) % SEGMENTS)}) & 65535L)"
        turned = f"IF(bit_count({then}) % 2 = 0, transform(sequence(0, {WIDTH - 1}), b -> {then} ^ shiftleft(1L, b)), array())"
        parts.append(f"transform(concat(array({then}), {turned}), s -> {i}L * 4294967296L + {own} * 65536L + s)")
    return distinct.select(F.explode(F.expr(f"concat({', '.join(parts)})")).alias("key"), "fp")


def ring_passes(a: str, b: str) -> str:
    """SQL: from some segment on, each chain stays within its share of the budget; the last one is the full check."""
    diff = f"({a} ^ {b})"
    seg = [f"bit_count(shiftrightunsigned({diff}, {WIDTH * i}) & 65535L)" for i in range(SEGMENTS)]
    starts = []
    for i in range(SEGMENTS):
        ring = [seg[(i + k) % SEGMENTS] for k in range(SEGMENTS)]
        starts.append("(" + " AND ".join(f"{' + '.join(ring[: c + 1])} <= {(c + 1) * MAX_BITS // SEGMENTS}" for c in range(SEGMENTS)) + ")")
    return "(" + " OR ".join(starts) + ")"


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within MAX_BITS of each other: fewer than there are fingerprints."""
    fps, links = np.unique(fps.astype(np.int64).view(np.uint64)), []
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = np.bitwise_count(fps[left] ^ fps[at]) <= MAX_BITS
            found, left = left[close], left[~close]
            links += [(int(at), int(x)) for x in found]
            queue.extend(found)
    signed = fps.view(np.int64)
    return [(int(signed[a]), int(signed[b])) for a, b in links]


def links_of(distinct: DataFrame, folder: str, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """a, b: pairs of distinct fingerprints that connect all that differ in at most MAX_BITS bits."""
    keys = chain_keys(distinct.select("fp"))
    live = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(live.hint("merge"), "key"), folder, "members")  # the same plan at every size
    few = members.where(F.col("n") <= small).groupBy("key").agg(F.sort_array(F.collect_set("fp")).alias("fps"))
    pairs = few.select(F.explode(F.expr("transform(slice(fps, 1, size(fps) - 1), (x, i) -> struct(x AS a, filter(slice(fps, i + 2, size(fps)), y -> {0}) AS rest))".format(ring_passes("x", "y")))).alias("p"))
    pairs = pairs.select("p.a", F.explode("p.rest").alias("b")).distinct()
    many = members.where(F.col("n") > small)
    if not many.limit(1).count():
        return pairs
    dealt = many.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")).withColumn("own", F.expr("pmod(xxhash64(fp), blocks)"))
    dealt = dealt.select("key", "fp", "own", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("other"))
    dealt = dealt.select("key", "fp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def forests(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(pdf["fp"].to_numpy()), columns=["a", "b"], dtype="int64")

    spread = dealt.groupBy("key", "low", "high").applyInPandas(forests, "a long, b long")
    return pairs.unionByName(spread.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """node, root: the smallest node that each linked node reaches, by rounds of large and small stars.

    Every round is written to the shared folder; the driver sees only whether a round has changed a link. The links of a
    node with a large share of them stay where they are, and what its node needs is broadcast (`lookup`).
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v"), folder, "edges-0")
    if not edges.limit(1).count():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    for turn in range(1, 200):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both, written(least, folder, f"least-{turn}"), "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # v > m as m <= u
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        down = written(down, folder, f"down-{turn}")
        lowest = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), folder, f"lowest-{turn}")
        linked = lookup(down, lowest, "u", "n")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        new = written(small, folder, f"edges-{turn}")
        done = not new.join(edges, ["u", "v"], "left_anti").limit(1).count() and new.count() == edges.count()
        edges = new
        for old in (f"edges-{turn - 1}", f"least-{turn}", f"down-{turn}", f"lowest-{turn}"):
            remove(links.sparkSession, f"{folder}/{old}")
        if done:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("the components did not settle")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links of at most MAX_BITS bits) for every row."""
    small_batches(docs.sparkSession)
    folder = shared_folder(docs.sparkSession)
    rows = written(fingerprints(docs, id_col, text_col, shingle), folder, "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), folder, "distinct")
    roots = components(links_of(distinct, folder), folder)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    named = written(named, folder, "named")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    facts = written(lookup(named, names, "root", "size").select("fp", "n", "component_id"), folder, "facts")
    return lookup(rows, facts, "fp", "n").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's word shingles; fewer words make one shingle, none no shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        found = [digest(b" ".join(words), 42)] if words else []
    else:
        found = {digest(b" ".join(words[i : i + shingle]), 42) for i in range(len(words) - shingle + 1)}
    return np.unique(np.fromiter(found, np.uint64, len(found)).view(np.int64))


class Similar:
    """Texts by their shingle sets: which ones have a Jaccard similarity of SIMILAR or more, exactly.

    A text is compared with all others at once, by counting its shingles' owners. Empty sets are alike.
    """

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray]) -> None:
        self.nodes, first = np.unique(nodes, return_index=True)
        sets = [sets[i] for i in first]
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.ends = self.sizes.cumsum()
        _, self.number = np.unique(np.concatenate(sets), return_inverse=True)
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(self.number, kind="stable")]
        self.holders = np.bincount(self.number) if len(self.number) else np.zeros(1, np.int64)
        self.begin = self.holders.cumsum() - self.holders

    def like(self, at: int) -> np.ndarray:
        """For each text, whether it is similar to the one at `at`."""
        mine = self.number[self.ends[at] - self.sizes[at] : self.ends[at]]
        n = self.holders[mine]
        lists = self.owners[np.repeat(self.begin[mine] - (n.cumsum() - n), n) + np.arange(n.sum())]
        shared = np.bincount(lists, minlength=len(self.nodes))
        return PARTS * shared >= (PARTS - 1) * (self.sizes[at] + self.sizes - shared)

    def labels(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the places of the first text of its component and of the similar one from which it was found."""
        left, label, parent = np.ones(len(self.nodes), bool), np.arange(len(self.nodes)), np.arange(len(self.nodes))
        for start in range(len(self.nodes)):
            if not left[start]:
                continue
            left[start], queue = False, [start]
            while queue and left.any():
                at = queue.pop()
                found = np.flatnonzero(left & self.like(at))
                left[found], label[found], parent[found] = False, start, at
                queue.extend(found.tolist())
        return label, parent


def verified_links(docs: DataFrame, members: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", block: int = SHINGLES) -> DataFrame:
    """a, b: links that connect, inside each candidate group, all texts with a similarity of SIMILAR or more, and no others.

    `members` has root, node, first_id and hash (of the row whose text it is) and n_words. A group is dealt into blocks of about
    `block` shingles. First each block finds its components by itself. Of a group with several blocks, the first texts of
    the blocks' largest components are held against each other, which makes the group's main component known; all
    texts outside of it are then sent to every block of the group, those inside stay where they are, as they are linked
    already. So what a group of many copies is sent follows its size, and every pair that could still add a link is compared.
    """
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n_words") / block).cast("long").alias("blocks"), F.count(F.lit(1)).alias("n_nodes"))
    blocks = blocks.withColumn("blocks", F.greatest("blocks", F.lit(1).cast("long")))
    dealt = lookup(members, blocks, "root", "n_nodes").withColumn("own", F.expr("pmod(xxhash64(node), blocks)")).drop("n_nodes", "n_words")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc_text(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    asked = members.select("hash")
    if asked.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # else all texts are shuffled, behind Spark's own Bloom filter
        texts = texts.join(F.broadcast(asked.distinct()), "hash", "left_semi")
    dealt = dealt.hint("merge")  # the same plan at every size
    rows = texts.join(dealt, (texts.hash == dealt.hash) & texts.doc_id.eqNullSafe(dealt.first_id)).select("node", "root", "own", "blocks", "text")
    rows = rows.dropDuplicates(["node"])  # repeated rows

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns="text")
            out["shingles"] = [shingle_set(t) for t in pdf["text"]]
            yield out

    rows = written(rows.mapInPandas(hashed, "node long, root long, own long, blocks long, shingles array<long>"), folder, "shingles")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        found = Similar(pdf["node"].to_numpy(), list(pdf["shingles"]))
        label, parent = found.labels()
        largest = np.bincount(label, weights=found.sizes + 1).argmax()
        out = pd.DataFrame({"root": pdf["root"].iloc[0], "node": found.nodes, "label": found.nodes[label], "parent": found.nodes[parent], "shingles": None})
        if pdf["blocks"].iloc[0] > 1:
            out.at[largest, "shingles"] = pdf["shingles"].iloc[int(np.flatnonzero(pdf["node"].to_numpy() == found.nodes[largest])[0])]
        return out

    labelled = written(rows.groupBy("root", "own").applyInPandas(inside, "root long, node long, label long, parent long, shingles array<long>"), folder, "labelled")

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        found = Similar(pdf["label"].to_numpy(), list(pdf["shingles"]))
        label, parent = found.labels()
        main = np.bincount(label).argmax()
        return pd.DataFrame({"label": found.nodes, "parent": found.nodes[parent], "main": label == main})

    firsts = labelled.where("shingles IS NOT NULL").select("root", "label", "shingles")
    firsts = written(firsts.groupBy("root").applyInPandas(across, "label long, parent long, main boolean"), folder, "firsts-of-blocks")
    links = labelled.where("node <> parent").select(F.col("parent").alias("a"), F.col("node").alias("b"))
    links = links.unionByName(firsts.where("label <> parent").select(F.col("parent").alias("a"), F.col("label").alias("b")))
    if not firsts.limit(1).count():
        return links
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    mains = firsts.where("main").select("label").withColumn("main", F.lit(True)).join(sizes, "label", "right").withColumn("main", F.coalesce("main", F.lit(False)))
    marked = lookup(labelled.select("node", "label"), mains, "label", "n").select("node", "main")
    several = written(rows.where("blocks > 1").join(marked, "node"), folder, "several")
    open_groups = several.where(~F.col("main")).groupBy("root").agg(F.count(F.lit(1)).alias("n_open"))
    rest = several.join(open_groups, "root").withColumn("block", F.explode(F.when(F.col("main"), F.array("own")).otherwise(F.expr("sequence(0L, blocks - 1)"))))

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        found, main = Similar(pdf["node"].to_numpy(), list(pdf["shingles"])), dict(zip(pdf["node"], pdf["main"], strict=True))
        inner = np.array([main[x] for x in found.nodes.tolist()], bool)
        out = []
        for at in np.flatnonzero(~inner):
            like = found.like(at)
            others = np.flatnonzero(like & ~inner)
            out += [(found.nodes[at], found.nodes[x]) for x in [*others[others > at], *np.flatnonzero(like & inner)[:1]]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    more = rest.select("root", "block", "node", "shingles", "main").groupBy("root", "block").applyInPandas(linked, "a long, b long")
    return links.unionByName(more.distinct())


def candidate_links(nodes: DataFrame, folder: str, rounds: int) -> DataFrame:
    """a, b: links between `nodes` (node, fps) that connect all whose fingerprints of some round differ in at most MAX_BITS bits.

    Nodes with an equal fingerprint hang on the first of them, so no group is expanded into its pairs.
    """
    edges = None
    for t in range(rounds):
        mine = nodes.select("node", F.get("fps", F.lit(t)).alias("fp"))
        firsts = written(mine.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), folder, f"firsts-{t}")
        equal = lookup(mine, firsts, "fp", "n").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
        close = written(links_of(firsts.select("fp"), f"{folder}/round-{t}"), folder, f"links-{t}")
        end = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))  # noqa: B023, E731
        close = close.join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
        part = written(equal.unionByName(close), folder, f"pairs-{t}")
        remove(nodes.sparkSession, f"{folder}/round-{t}")
        edges = part if edges is None else edges.unionByName(part)
    return edges


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, hash (of the text), component_id for every row: texts are linked if their five-word shingles have a Jaccard
    similarity of SIMILAR or more; a component's name is its smallest id.

    Candidate groups come from fingerprints over words, by any of the rounds. Inside a group, every two different texts are held
    against each other by their shingles (`verified_links`), so no link rests on fingerprints alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_folder(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(doc_text(text_col)).alias("hash"), words_column(text_col, rounds).alias("w"))
    rows = written(rows.select("doc_id", "hash", "w.fps", "w.n_words"), folder, "fingerprints")
    # two texts are one node only if 64 bits of hash and all fingerprints are equal
    nodes = rows.groupBy("fps", "hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("n_words").alias("n_words"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), folder, "nodes")
    groups = written(components(candidate_links(nodes, folder, rounds), folder), folder, "groups")
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    members = written(nodes.join(groups, "node").select("root", "node", "first_id", "hash", "n_words"), folder, "members")
    links = written(verified_links(docs, members, folder, id_col, text_col), folder, "verified")
    roots = components(links, f"{folder}/verified-rounds").withColumnRenamed("node", "of")
    named = nodes.join(roots, nodes.node == roots.of, "left").select("fps", "hash", "first_id", "n", F.coalesce("root", "node").alias("root"))
    named = written(named, folder, "named")
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    facts = lookup(named, names, "root", "size").select(F.struct("fps", "hash").alias("key"), "n", "component_id")
    return lookup(rows.withColumn("key", F.struct("fps", "hash")), written(facts, folder, "facts"), "key", "n").select("doc_id", "hash", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group of near copies (see `near_copies`): the one with the smallest id."""
    found = near_copies(docs, id_col, text_col).withColumnRenamed("hash", "mark").withColumn("kept", F.expr("doc_id <=> component_id"))
    return apply_decisions(docs, found, F.xxhash64(doc_text(text_col)), False, id_col)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all of `documents`."""
    from tessera.sources.tables import table

    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

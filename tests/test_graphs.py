"""Graphs: deletion over deep chains in few rounds, components and witnesses against a plain search."""

import random

import pytest

from tessera.operators import incremental as im

EDGES = "node long, dep long"


def frame(spark, edges):
    return spark.createDataFrame(edges, EDGES).repartition(3)


def plain_left(edges, nodes):
    left = set(nodes)
    while True:
        bad = {n for n, d in edges if n in left and d not in left}
        if not bad:
            return left
        left -= bad


def test_a_chain_of_20000_links_takes_few_rounds(spark, monkeypatch):
    n, rounds = 20_000, []
    real = im.cut
    monkeypatch.setattr(im, "cut", lambda df: (rounds.append(1), real(df))[1])
    links = spark.range(1, n).selectExpr("id AS node", "id + 1 AS dep")
    nodes = spark.range(1, n).selectExpr("id AS node").unionByName(spark.range(30_000, 30_010).selectExpr("id AS node"))
    assert {r.node for r in im.drop_dangling(links, nodes).collect()} == set(range(30_000, 30_010))
    assert len(rounds) <= 3 + 4 * 17


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs_keep_what_rests_on_nothing_missing(spark, seed):
    rng = random.Random(seed)
    nodes = [i for i in range(150) if rng.random() < 0.97]
    edges = [(i, rng.choice([i + 1, i + 1, i - 3, rng.randrange(150)])) for i in range(150) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    edges += [(200, 201), (201, 202), (202, 200), (203, 200), (204, 204), (205, 204), (5, 5)]  # cycles that rest on nothing else
    nodes += [200, 201, 202, 203, 204, 205]
    got = im.drop_dangling(frame(spark, edges + edges[:9]), spark.createDataFrame([(n,) for n in nodes], "node long"))
    assert {r.node for r in got.collect()} == plain_left(edges, nodes)


def plain_components(edges):
    out, nodes = {}, {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        stack = [d for a, d in edges if a == n]
        while stack:
            x = stack.pop()
            if x not in reach[n]:
                reach[n].add(x)
                stack += [d for a, d in edges if a == x]
    for n in nodes:
        if n in reach[n]:
            out[n] = min(m for m in nodes if m in reach[n] and n in reach[m])
    return out


def test_components_and_witnesses(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(66)] + [(100, 101), (101, 102), (102, 103), (103, 100), (101, 100), (110, 110), (111, 112)]
    table = frame(spark, edges + edges[:5])
    held = im.components(table)
    want = plain_components(set(edges))
    assert {r.node: r.component for r in held.collect()} == want and len(set(want.values())) > 2
    paths = {r.component: r.path for r in im.witnesses(table, held).collect()}
    assert set(paths) == set(want.values())
    for c, path in paths.items():
        assert path[0] == path[-1] == c and len(set(path[:-1])) == len(path) - 1
        assert all((a, b) in set(edges) and want[a] == c for a, b in zip(path, path[1:]))
    assert paths[100] == [100, 101, 100] and paths[110] == [110, 110]
    assert im.components(table.limit(0)).collect() == []


def test_chains_of_neighbours_take_no_rounds(spark, monkeypatch):
    """Chains inside blocks are settled at once; only what leaves a block is led on."""
    n, left = 20_000, []
    real = im._fallen
    monkeypatch.setattr(im, "_fallen", lambda open_, bad: (left.append(open_.count()), real(open_, bad))[1])
    nodes = spark.range(1, n).selectExpr("id AS node").where("node % 500 <> 77")
    links = spark.range(1, n).selectExpr("id AS node", "id - 1 AS dep").where("node % 700 <> 1")
    want = [i for i in range(1, n) if not any(j % 500 == 77 for j in range((i - 1) // 700 * 700 + 1, i + 1))]
    assert sorted(r.node for r in im.drop_dangling(links, nodes).collect()) == want
    assert sum(left) <= 4 * 700


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_blocks_of_any_size_keep_the_same(spark, monkeypatch, block):
    rng = random.Random(block)
    nodes = [i for i in range(150) if rng.random() < 0.97]
    edges = [(i, rng.choice([i + 1, i + 1, i - 3, rng.randrange(150)])) for i in range(150) for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    edges += [(200, 201), (201, 202), (202, 200), (203, 200), (204, 204), (205, 204), (5, 5), (206, None), (207, 206), (208, 201), (208, 206)]
    nodes += [*range(200, 209), None]
    monkeypatch.setattr(im, "BLOCK", block)
    names = frame(spark, edges).selectExpr("concat('n', node) AS node", "concat('n', dep) AS dep")
    many = spark.createDataFrame([(n,) for n in nodes], "node long")
    want = plain_left(edges, nodes[:-1]) | {None}  # an edge to null leads to nothing
    assert {r.node for r in im.drop_dangling(frame(spark, edges), many).collect()} == want
    assert {r.node for r in im.drop_dangling(names, many.selectExpr("concat('n', node) AS node")).collect()} == {n if n is None else f"n{n}" for n in want}


def test_long_cycles_take_few_rounds(spark, monkeypatch):
    """Cycles alone and between hubs, of links in no order, beside chains that lead to and from them: colours meet hubs only."""
    met, rounds = [], []
    real, cut = im._coloured, im.cut
    monkeypatch.setattr(im, "_coloured", lambda edges: (met.append(edges.count()), real(edges))[1])
    monkeypatch.setattr(im, "cut", lambda df: (rounds.append(1), cut(df))[1])
    names = list(range(1000))
    random.Random(3).shuffle(names)
    ring = lambda some: list(zip(some, some[1:] + some[:1]))
    edges = ring(names[:300]) + ring(names[300:305]) + ring(names[305:307])
    edges += ring(names[400:500]) + ring([names[400], *names[500:560]])  # two cycles through one hub
    edges += list(zip(names[600:640], names[601:640])) + [(names[700], names[600]), (names[639], names[710])]  # a chain from one cycle to the next
    edges += ring(names[700:710]) + ring(names[710:720]) + [(names[720], names[720]), (names[721], names[722])]
    want = {n: min(some) for some in (names[:300], names[300:305], names[305:307], names[400:560], names[700:710], names[710:720], names[720:721]) for n in some}
    held = im.components(frame(spark, edges))
    assert {r.node: r.component for r in held.collect()} == want and held.count() == len(want)
    assert sum(met) < 20 and len(rounds) < 50
    small = held.join(held.groupBy("component").count().where("count < 50").select("component"), "component").select("node", "component")
    paths = {r.component: r.path for r in im.witnesses(frame(spark, edges), small).collect()}
    assert set(paths) == {c for c in want.values() if list(want.values()).count(c) < 50}
    assert all(set(zip(path, path[1:])) <= set(edges) and path[0] == path[-1] == c and len(path) == list(want.values()).count(c) + 1 for c, path in paths.items())


@pytest.mark.parametrize("ring", [0, 64])
def test_cycles_in_a_row_and_in_rounds_are_the_same(spark, monkeypatch, ring):
    monkeypatch.setattr(im, "RING", ring)
    edges = [(3, 9), (9, 4), (4, 3), (3, 3), (20, 25), (25, 22), (22, 20), (30, 30), (40, 41), (41, 40), (40, 42), (42, 40), (20, 30)]
    table = frame(spark, edges + edges[:4])
    assert {r.component: r.path for r in im.witnesses(table, im.components(table)).collect()} == {3: [3, 3], 20: [20, 25, 22, 20], 30: [30, 30], 40: [40, 41, 40]}

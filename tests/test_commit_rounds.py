"""First committer wins by rounds: equal to the fold in order, also for one group that holds half of the rows."""

import random

import pytest

from tessera.operators import numbering
from tessera.operators import versioned as kv

SCHEMA = "part long, txn long, key long, begin long, commit long"


def plain(rows):
    """The definition, transaction by transaction."""
    txns, out, last = {}, set(), {}
    for part, txn, key, begin, commit in rows:
        txns.setdefault((part, commit, txn), [begin, set()])[1].add(key)
    for (part, commit, txn), (begin, keys) in sorted(txns.items()):
        ok = all(last.get((part, k), -1) <= begin for k in keys)
        if ok:
            last.update({(part, k): commit for k in keys})
        out.add((part, txn, ok))
    return out


def write_sets(seed, sizes, keys, life):
    rng, rows, txn = random.Random(seed), [], 0
    for part, n in enumerate(sizes):
        for commit in range(1, n + 1):
            txn += 1
            begin = max(0, commit - 1 - rng.randrange(life))
            rows += [(part, txn, k, begin, commit) for k in {rng.randrange(keys) for _ in range(rng.randint(1, 3))}]
    return rows


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("seed, sizes, keys, life", [(1, [5, 1, 30, 0, 12], 4, 5), (2, [150, *[5] * 30], 40, 12)])
def test_equal_to_the_fold(spark, monkeypatch, seed, sizes, keys, life):
    monkeypatch.setattr(numbering, "BLOCK", 16)
    rows = write_sets(seed, sizes, keys, life)
    writes = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    assert got(kv.commit_rounds(writes, "part", 3)) == want == got(kv.commit_fold(writes, "part"))
    assert any(not ok for *_, ok in want)


def test_a_chain_is_decided_in_order_at_last(spark):
    """Every transaction overlaps the one before it, so every second one commits; more of them than rounds."""
    rows = [(0, n, 7, max(0, n - 2), n) for n in range(1, 8)]
    want = plain(rows)
    assert {t for _, t, ok in want if ok} == set(range(1, 8, 2))
    for rounds in (2, 9):
        found = kv.commit_rounds(spark.createDataFrame(rows, SCHEMA), "part", rounds)
        assert got(found) == want


def test_what_failed_blocks_nobody(spark):
    rows = [(0, 1, 1, 0, 1), (0, 2, 1, 0, 2), (0, 2, 2, 0, 2), (0, 3, 2, 0, 3)]
    assert got(kv.commit_rounds(spark.createDataFrame(rows, SCHEMA), "part")) == {(0, 1, True), (0, 2, False), (0, 3, True)}
    assert kv.commit_rounds(spark.createDataFrame([], SCHEMA), "part").collect() == []


def test_later_rounds_hold_what_is_open_only(spark, monkeypatch):
    """300 lone transactions, and a chain of 6: lone ones are no rows of the second round, nor are those that won before it."""
    held, real = [], kv.largest_before
    monkeypatch.setattr(kv, "largest_before", lambda rows, *a: (held.append(rows.count()), real(rows, *a))[1])
    rows = [(0, n, 7, max(0, n - 2), n) for n in range(1, 7)] + [(0, n, n, n - 1, n) for n in range(10, 310)]
    assert got(kv.commit_rounds(spark.createDataFrame(rows, SCHEMA), "part")) == plain(rows)
    assert held[0] == 306 and max(held[1:]) <= 6 and held == sorted(held, reverse=True)

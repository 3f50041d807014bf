"""Histories of hot keys are taken in blocks: one key holds half of all rows and each block is small."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import incremental as im
from tessera.operators import numbering
from tessera.operators import versioned as kv
from tessera.operators.numbering import numbered
from tessera.plans import pk

SF = "/root/testdata/sf0.001"


def history(n=400):
    rng = random.Random(3)
    return [("hot" if i % 2 else f"k{rng.randrange(20)}", i + 1, rng.choice([1.0, 2.0, None]), rng.random() < 0.3) for i in range(n)]


@pytest.fixture
def log(spark, monkeypatch):
    monkeypatch.setattr(numbering, "BLOCK", 16)
    return spark.createDataFrame(history(), "key string, version long, value double, is_delete boolean").repartition(6)


def by_key():
    out = {}
    for k, n, x, d in history():
        out.setdefault(k, []).append((n, x, d))
    return out


def test_prune(log):
    for upto in (0, 33, 200, 400):
        want = set()
        for k, rows in by_key().items():
            stay = [r for i, r in enumerate(rows) if i + 1 == len(rows) or rows[i + 1][0] > upto]
            if not (len(stay) == 1 and stay[0][2] and stay[0][0] <= upto):
                want |= {(k, *r) for r in stay}
        assert {tuple(r) for r in kv.prune(log, upto).collect()} == want


def test_delete_existed(log):
    want = {(k, n, i > 0 and not rows[i - 1][2]) for k, rows in by_key().items() for i, (n, _, d) in enumerate(rows) if d}
    assert {tuple(r) for r in kv.delete_existed(log).collect()} == want


def test_changes_and_changed_at(log):
    want, revision, last, at = {}, 0, {}, {}
    for k, n, x, _ in history():
        changed = k not in last or last[k] != x
        revision += changed
        at[k] = revision if changed else at[k]
        last[k] = x
        want[n] = (changed, revision, at[k])
    got = {r.version: (r.changed, r.revision, r.changed_at) for r in im.revisions(log.select("key", "version", "value")).collect()}
    assert got == want


def test_asof_join(spark, log):
    rng = random.Random(5)
    asked = [(i, rng.choice(["hot", "k1", "k7", "gone", None]), rng.randrange(-2, 420)) for i in range(300)] + [(300, "hot", 77), (301, "hot", 77)]
    got = {r.id: (r.found_version, r.value) for r in kv.asof_join(spark.createDataFrame(asked, "id long, key string, at long"), log).collect()}
    for i, k, at in asked:
        rows = [r for r in by_key().get(k, []) if r[0] <= at]
        assert got[i] == ((rows[-1][0], rows[-1][1]) if rows and not rows[-1][2] else (None, None))
    assert len(got) == len(asked)


def test_conflicts_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(kv, "COMMITS", 8)
    rng = random.Random(1)
    rows = [(i, "hot" if i % 2 else "cold", max(0, i - rng.choice([1, 2, 5, 40])), i) for i in range(1, 200)]
    got = {tuple(r) for r in kv.conflicts_pairwise(spark.createDataFrame(rows, "txn long, key string, begin long, commit long")).collect()}
    assert got == {(a, b, k) for a, k, begin, commit in rows for b, other, _, done in rows if k == other and begin < done < commit}


def test_equal_values_are_split_over_ranges(spark):
    rows = spark.range(1000).selectExpr("id", "1L AS by").repartition(3)
    got = numbered(rows, "n", F.col("by"), ["id"], ranges=7)
    assert {r.id: r.n for r in got.collect()} == {i: i + 1 for i in range(1000)}


def test_causes_are_minimal(spark):
    """Taken from all assignments: no choice meets all the causes of a universe, and without any one of them some does."""
    releases, requirements, roots = (df.collect() for df in pk.universes(spark, SF))
    said = {}
    for r in pk.pk_explain(spark, SF).collect():
        said.setdefault(r.universe, []).append(r.cause)
    assert said

    def admits(spec, x):
        def holds(c):
            (op, b) = next((o, c[len(o) :]) for o in ("==", "!=", ">=", "<=", ">", "<") if c.startswith(o))
            major = int(b.split(".")[0])
            return {"==": x == major, "!=": x != major, ">=": x >= major, "<=": x <= major, ">": x > major, "<": x < major}[op]

        return spec == "*" or all(map(holds, spec.split(",")))

    def solvable(u, causes):
        offers = {p: [r.version.major for r in releases if r.universe == u and r.package == p] for p in "abc"}
        for chosen in itertools.product(*([None, *offers[p]] for p in "abc")):
            has = dict(zip("abc", chosen))

            def met(cause):
                who, what = cause.split(": ")
                target, spec = what.split(" ")
                asks = who == "root" or (has[who.split(" ")[0]] is not None and f"{has[who.split(' ')[0]]}.0.0" in who.split(" ")[1:])
                return not asks or (has[target] is not None and admits(spec, has[target]))

            if all(map(met, causes)):
                return True
        return False

    for u, causes in said.items():
        assert not solvable(u, causes)
        for c in causes:
            assert solvable(u, [x for x in causes if x != c])

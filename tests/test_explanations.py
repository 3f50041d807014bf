"""Explanations of universes without a solution: each of the checks on its own, and minimality against leaving facts out in turn."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.functions import versions as v
from tessera.operators.constraints import explanation_problems

FACTS = "u int, fact string, package string, vs string, target string, spec string"


def found(spark, releases, requirements, roots, facts):
    """(u, problem, fact) of universes given as texts."""
    rel = spark.createDataFrame(releases, "u int, package string, version string").withColumn("version", v.version(F.col("version")))
    req = spark.createDataFrame(requirements, "u int, package string, version string, target string, spec string")
    req = req.select("u", "package", v.version(F.col("version")).alias("version"), "target", v.version_range(F.col("spec")).alias("range"))
    top = spark.createDataFrame(roots, "u int, target string, spec string").select("u", "target", v.version_range(F.col("spec")).alias("range"))
    told = spark.createDataFrame(facts, FACTS).select("u", "fact", "package", v.version_range(F.col("vs")).alias("versions"), "target", v.version_range(F.col("spec")).alias("range"))
    return sorted(((r.u, r.problem, r.fact) for r in explanation_problems(told, rel, req, top, "u").collect()), key=str)


def test_each_check(spark):
    """In every universe a 1 and a 2 ask for b >= 2, and b has 1 and 2; the roots ask for a and for b < 2."""
    releases = [(u, p, f"{n}.0.0") for u in range(7) for p in ("a", "b") for n in (1, 2)]
    requirements = [(u, "a", f"{n}.0.0", "b", ">=2.0.0") for u in range(7) for n in (1, 2)]
    roots = [(u, *r) for u in range(7) for r in (("a", "*"), ("b", "<2.0.0"))]
    a, b, needs = ("root a", None, None, "a", "*"), ("root b", None, None, "b", "<2.0.0"), ("needs", "a", ">=1.0.0", "b", ">=2.0.0")
    told = {
        0: [a, b, needs],  # sound
        1: [a, b, needs, ("never", None, None, "b", "<1.0.0")],
        2: [a, b, ("false", "a", "*", "b", ">=3.0.0")],  # b 2 is admitted by the registry and not by the fact
        3: [a, b],
        4: [a, b, needs, ("spare", "a", "==1.0.0", "b", ">=2.0.0")],
        5: [a, b, needs, ("none", "b", "*", "a", "*")],  # b asks for nothing
        6: [],
    }
    facts = [(u, *f) for u, fs in told.items() for f in fs]
    assert found(spark, releases, requirements, roots, facts) == sorted([(1, "E2", "never"), (2, "E3", "false"), (3, "E4", None), (4, "E5", "spare"), (5, "E3", "none"), (6, "E4", None)], key=str)


def test_minimality_against_leaving_out(spark):
    rng = random.Random(9)
    releases, requirements, roots, facts, want = [], [], [], [], []
    for u in range(25):
        packages = ["a", "b", "c"]
        held = {p: list(range(1, rng.randint(2, 4))) for p in packages}
        releases += [(u, p, f"{n}.0.0") for p in packages for n in held[p]]
        asks = [(p, n, t, rng.randint(1, 3)) for p in packages for n in held[p] for t in packages if t != p and rng.random() < 0.6]
        requirements += [(u, p, f"{n}.0.0", t, f"=={k}.0.0") for p, n, t, k in asks]
        mine = [("root a", None, None, "a", None)] + [(f"{p} {n} {t}", p, n, t, k) for p, n, t, k in asks]
        roots.append((u, "a", "*"))
        facts += [(u, f, p, None if p is None else f"=={n}.0.0", t, "*" if k is None else f"=={k}.0.0") for f, p, n, t, k in mine]

        def satisfiable(cited, held=held):
            for choice in itertools.product(*([None, *held[p]] for p in ("a", "b", "c"))):
                at = dict(zip("abc", choice, strict=True))
                if all((p is not None and at[p] != n) or (at[t] is not None and k in (None, at[t])) for _, p, n, t, k in cited):
                    return True
            return False

        if satisfiable(mine):
            want.append((u, "E4", None))
        else:
            want += [(u, "E5", f[0]) for f in mine if not satisfiable([g for g in mine if g is not f])]
    got = found(spark, releases, requirements, roots, facts)
    assert got == sorted(want, key=str) and {p for _, p, _ in want} == {"E4", "E5"}

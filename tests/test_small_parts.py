"""Families of universes, profiles of lines, the counting sink, damaged checkpoints and cut log tails."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import constraints as pk
from tessera.operators import solver
from tessera.sources import framed_log
from tessera.sources.counting import write_counted
from tessera.sources.store import CorruptStoreError, VersionedStore
from tessera.synth import telemetry, universes


def test_families(spark):
    got = solver.resolve(*universes.chains(spark, 2, 4, 3), "universe").collect()
    assert {(r.universe, r.package, r.version) for r in got} == {(u, f"p{k}", "3.0.0") for u in range(2) for k in range(4)}
    causes = solver.resolve(*universes.exclusive(spark, 1, 3), "universe").collect()
    assert not any(r.solved for r in causes) and len(causes) == 4  # two sides, asked for by the root, exclude each other


def test_solver_prefers_what_the_law_names(spark):
    releases, requirements, roots = universes.random(spark, 25, 4, 3, seed=3)
    found = solver.resolve(releases, requirements, roots, "universe")
    valid = pk.valid_assignments(pk.assignments(releases, "universe"), requirements, roots, "universe")
    want = {(r.universe, r.package, ".".join(map(str, r.version))) for r in pk.preferred(valid, requirements, roots, "universe").collect()}
    assert {(r.universe, r.package, r.version) for r in found.where("solved").collect()} == want and want
    assert {r.universe for r in found.where("NOT solved").collect()} == set(range(25)) - {u for u, *_ in want}


def test_profiles(spark):
    for name, make in telemetry.PROFILES.items():
        a, b = make(spark, 200, 5), make(spark, 200, 5).repartition(7)
        rows = sorted(map(tuple, a.select("id", "line").collect()))
        assert rows == sorted(map(tuple, b.select("id", "line").collect())) and [i for i, _ in rows] == list(range(200)), name
    distinct = lambda make: make(spark, 200, 5).select("line").distinct().count()
    assert distinct(telemetry.random) == 200 and distinct(telemetry.repeated) == 1 and distinct(telemetry.cycle) == 7


def test_counting_sink(spark, tmp_path):
    rows = spark.range(50).select(F.expr("repeat('x', CAST(id AS INT))").alias("line"))
    assert write_counted(rows, "line", f"{tmp_path}/out") == {"writes": 50, "bytes": 49 * 25, "largest": 49}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50


def test_damaged_checkpoint(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/db")
    store.put("a", "1")
    upto = store.checkpoint()
    assert store.get("a") == "1"
    for f in (tmp_path / "db" / "checkpoint" / f"upto={upto}").glob("*.parquet"):
        f.write_bytes(b"not a table")
    for crc in (tmp_path / "db" / "checkpoint" / f"upto={upto}").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(CorruptStoreError):
        store.get("a")


def test_cut_tail(tmp_path):
    path = tmp_path / "x.log"
    good = framed_log.encode_commit(1, [(b"k", b"v")])
    path.write_bytes(good + framed_log.encode_commit(2, [(b"k", b"w")])[:-3])
    assert framed_log.truncate_tail(str(path)) > 0 and path.read_bytes() == good and framed_log.truncate_tail(str(path)) == 0
    path.write_bytes(good + framed_log.encode_commit(2, [(b"k", b"w")]))
    with open(path, "rb") as f:
        assert [v for _, v, _ in framed_log.read_records(f)] == [1, 2]

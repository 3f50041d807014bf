"""The framed log, the store, the report readers, the streams and the generators."""

import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import framed_log as fl
from tessera.sources import reports
from tessera.sources.store import ClosedError, ConflictError, StoreError, VersionedStore
from tessera.streaming.views import IncrementalView, only_changes
from tessera.synth import telemetry


def history():
    return [fl.encode_commit(i + 1, [(b"k%03d" % i, b"v%03d" % i)] if i != 5 else [(b"k001", None), (b"", b"x" * 300)]) for i in range(10)]


def test_framed_log_reads_a_prefix_of_any_damaged_file(spark, tmp_path):
    spark.dataSource.register(fl.FramedLog)
    records = history()
    whole = b"".join(records)
    path = tmp_path / "a.log"
    path.write_bytes(whole)
    rows = spark.read.format("framed_log").load(str(tmp_path)).orderBy("offset").collect()
    assert [r.version for r in rows] == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10] and rows[5].is_delete and rows[5].value is None
    ends = [sum(map(len, records[: i + 1])) for i in range(10)]
    for share in (0, 0.17, 0.33, 0.5, 0.66, 0.8, 0.93, 0.99):
        cut = int(len(whole) * share)
        found = [v for _, v, _ in fl.read_records(io.BytesIO(whole[:cut]))]
        assert found == list(range(1, 1 + sum(e <= cut for e in ends)))
    for share in (0.05, 0.2, 0.4, 0.55, 0.7, 0.85, 0.95, 0.999):
        at = int(len(whole) * share)
        bad = whole[:at] + bytes([whole[at] ^ 0xFF]) + whole[at + 1 :]
        found = [v for _, v, _ in fl.read_records(io.BytesIO(bad))]
        assert found == list(range(1, 1 + sum(e <= at for e in ends)))
    # appending goes on where the good records end
    path.write_bytes(whole[: ends[3] + 5])
    with open(path, "r+b") as f:
        f.truncate(fl.good_length(str(path)))
        f.seek(0, os.SEEK_END)
        f.write(records[4])
    assert spark.read.format("framed_log").load(str(path)).agg(F.max("version")).first()[0] == 5


def test_payload_decoding_refuses_short_and_long_ones():
    body = history()[0][8:]
    assert fl.decode_payload(body) == (1, [(b"k000", b"v000")])
    for bad in (body[:-1], body + b"x", body[:4]):
        with pytest.raises(ValueError):
            fl.decode_payload(bad)


def test_store(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    store.put("a", "1")
    store.put("b", "2")
    old = store.begin()
    assert store.delete("a") and not store.delete("zz")
    assert old.get("a") == "1" and store.get("a") is None and store.version() == 4
    store.put("c", "3")
    assert [r.key for r in old.scan().collect()] == ["a", "b"]  # no phantoms
    old.put("b", "mine")
    old.delete("a")
    assert [(r.key, r.value) for r in old.scan().collect()] == [("b", "mine")]
    with pytest.raises(ConflictError):
        old.commit()
    with pytest.raises(ClosedError):
        old.get("b")
    with store.begin() as t, store.begin() as u:  # write skew is allowed
        t.put("x", u.get("b"))
        u.put("y", t.get("b"))
    assert store.get("x") == "2" and store.get("y") == "2"
    with pytest.raises(StoreError):
        store.put("", "v")
    open_ = store.begin()
    store.put("b", "9")
    at = store.checkpoint()
    assert at == open_.snapshot and open_.get("b") == "2" and store.get("b") == "9"
    open_.rollback()
    open_.rollback()
    store.checkpoint()
    again = VersionedStore(spark, f"file://{tmp_path}/store")
    assert [(r.key, r.value) for r in again.scan().collect()] == [("b", "9"), ("c", "3"), ("x", "2"), ("y", "2")]
    assert again.version() == store.version() and again.stats()["log_bytes"] == 0
    again.put("d", "4")
    assert again.get("d") == "4" and [r.key for r in again.scan("d").collect()] == ["d"]


def test_a_commit_without_its_mark_never_was(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")
    store.put("a", "1")
    store.put("a", "2")
    os.remove(tmp_path / "store/log/version=2/_SUCCESS")
    assert VersionedStore(spark, f"file://{tmp_path}/store").get("a") == "1"


def test_reports(spark, tmp_path):
    doc = {"score": 0.5, "threshold": 1.0, "categories": [{"name": "a", "weight": 1.0, "checks": [{"name": "x", "points": 2, "earned": 1, "detail": "d"}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    checks = reports.read_json_report(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in checks.collect()] == [("a", 1.0, "x", 2.0, 1.0, "d")]
    reports.write_json_report(checks, str(tmp_path / "out"))
    assert reports.read_json_report(spark, str(tmp_path / "out")).collect() == checks.collect()
    cases = spark.createDataFrame([("c", "one", 0.1, "passed"), ("c", "two", 0.2, "failed"), ("c", "three", 0.3, "skipped")], "classname string, name string, time double, outcome string")
    reports.write_junit(cases, str(tmp_path / "junit"))
    back = reports.read_junit(spark, str(tmp_path / "junit"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cases.collect()))
    assert tuple(reports.junit_summary(back).first()) == (3, 1, ["c::two"])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dir/a.txt", "hello")
    assert [(r.name, r.size, r.ok) for r in reports.archive_entries(spark, str(tmp_path / "a.zip")).collect()] == [("dir/a.txt", 5, True)]


def _fill(folder, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir())):03d}.json").write_text("\n".join(map(json.dumps, rows)))


def test_stream_of_changes(spark, tmp_path):
    _fill(tmp_path / "in", [{"key": 1, "version": v, "value": x} for v, x in enumerate(["a", "a", "b", None, None, "b"])] + [{"key": 2, "version": 9, "value": "z"}])
    stream = spark.readStream.schema("key long, version long, value string").json(str(tmp_path / "in"))
    run = lambda: only_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    run()
    _fill(tmp_path / "in", [{"key": 1, "version": 6, "value": "b"}, {"key": 1, "version": 2, "value": "late"}, {"key": 2, "version": 10, "value": "y"}])
    run()
    rows = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: r[:2])
    assert rows == [(1, 0, "a"), (1, 2, "b"), (1, 3, None), (1, 5, "b"), (2, 9, "z"), (2, 10, "y")]


def test_incremental_view(spark, tmp_path):
    view = IncrementalView(f"file://{tmp_path}/view")
    rng, total = random.Random(1), {}
    for batch in range(3):
        rows = [{"group": f"g{rng.randrange(4)}", "cents": rng.randrange(-5, 50)} for _ in range(20)] + [{"group": "idle", "cents": 0}]
        for r in rows:
            total[r["group"]] = total.get(r["group"], 0) + r["cents"]
        _fill(tmp_path / "in", rows)
        stream = spark.readStream.schema("group string, cents long").json(str(tmp_path / "in"))
        view.start(stream, str(tmp_path / "cp")).awaitTermination(120)
    found = {r["group"]: r for r in view.read(spark, 2).collect()}
    assert {g: r.cents for g, r in found.items()} == total and found["idle"].changed_at == 0
    view.apply(spark.createDataFrame([("g0", 1000)], "group string, cents long"), 2)  # a batch that is run again
    assert {r["group"]: r.cents for r in view.read(spark, 2).collect()} == total


def test_generators_do_not_depend_on_partitioning(spark):
    for make in (*telemetry.PROFILES.values(), telemetry.binlog):
        a = make(spark, 200, 7).collect()
        assert sorted(map(tuple, make(spark, 200, 7).repartition(3).collect())) == sorted(map(tuple, a))
        assert a != make(spark, 200, 8).collect()
    line = telemetry.csv(spark, 5, 1).first().line
    assert len(line.split(",")) == 5
    assert json.loads(telemetry.jsonl(spark, 5, 1).first().line)["tg"]


def test_toml_records(spark, tmp_path):
    from pyspark.sql.types import StructType

    from tessera.sources.records import read_toml

    (tmp_path / "a.toml").write_text('version = "1"\n[agent]\ntimeout_sec = 60.5\nextra = 1\n')
    (tmp_path / "b.toml").write_text('version = "2"\n')
    schema = StructType.fromDDL("version string, agent struct<timeout_sec: double>")
    rows = {r.version: r.agent for r in read_toml(spark, str(tmp_path), schema).collect()}
    assert rows["1"].timeout_sec == 60.5 and rows["2"] is None

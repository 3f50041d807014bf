"""Registries from nested records, and the data source over an object with two methods: a lookup asks for one package."""

import json
import os

from tessera.operators import constraints as pk
from tessera.sources import package_registry as registry

DATA = {
    "core": {"1.0.0": [], "1.2.0": ["util >=1.0.0"], "2.0.0": ["util >=2.0.0,!=2.5.0", "log"]},
    "util": {"1.0.0": [], "2.0.0": ["log <2.0.0"], "2.5.0": []},
    "log": {"1.0.0": [], "x": ["core >>1"]},
    "empty": {},
}


class Counted:
    """Leaves a file for each question, where the test can see it."""

    def __init__(self, folder):
        self.folder = folder

    def versions(self, package):
        open(os.path.join(self.folder, f"{package}-{os.urandom(4).hex()}"), "w").close()
        return DATA[package]

    def dependencies(self, package, version):
        return DATA[package][version]


def rows(df):
    return sorted((r.package, r.version, r.pos, r.requirement) for r in df.fillna({"pos": -1, "requirement": ""}).collect())


WANT = sorted((p, v, i, q) for p, vs in DATA.items() for v, qs in vs.items() for i, q in (enumerate(qs) if qs else [(-1, "")]))


def test_nested_records(spark):
    assert rows(registry.nested(spark, DATA)) == WANT
    records = spark.createDataFrame([(json.dumps({p: vs}),) for p, vs in DATA.items()] + [(None,), ("not json",)], "body string")
    assert rows(registry.from_nested(records, "body")) == WANT


def test_a_lookup_asks_for_one_package(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(registry.source_of(Counted(str(tmp_path)), DATA))
    table = spark.read.format("package_registry").load()
    assert rows(table.where("package = 'core' AND version <> '1.0.0'")) == [r for r in WANT if r[0] == "core" and r[1] != "1.0.0"]
    assert {f.split("-")[0] for f in os.listdir(tmp_path)} == {"core"}
    assert rows(table.where("package IN ('util', 'log')")) == [r for r in WANT if r[0] in ("util", "log")]
    assert {f.split("-")[0] for f in os.listdir(tmp_path)} == {"core", "util", "log"}
    assert rows(registry.ask(spark, ["nobody"])) == [] and rows(registry.ask(spark)) == WANT


def test_tables_of_a_registry(spark):
    found = registry.nested(spark, DATA)
    releases, requirements = registry.releases_of(found), registry.requirements_of(found)
    assert releases.count() == 7 and requirements.count() == 4
    got = {(r.package, r.version.major, r.target, r.found.major, r.found.minor) for r in pk.matches(requirements, releases).collect()}
    assert got == {("core", 1, "util", 1, 0), ("core", 1, "util", 2, 0), ("core", 1, "util", 2, 5), ("core", 2, "util", 2, 0), ("core", 2, "log", 1, 0), ("util", 2, "log", 1, 0)}
    assert {(r.package, r.version, r.problem) for r in registry.problems(found).collect()} == {("log", "x", "no version"), ("log", "x", "no requirement: core >>1")}

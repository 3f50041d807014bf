"""Registries of packages: from nested records, and a data source over any object with two methods.

An external registry has `versions(package)`, which gives version texts, and `dependencies(package, version)`, which gives
requirement texts. It lives outside Spark and may be slow to ask, so its source has one partition for each package
and takes equality and IN filters on `package` to ask only for what is wanted:

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source_of(registry, packages))
    spark.read.format("package_registry").load().where("package = 'core'")     # asks for one package

Load anew for every question, as `ask` does: Spark keeps what one loaded table was last filtered by.

Rows are package, version (text), pos and requirement; a release without requirements has one row whose pos and requirement
are null. `releases_of` and `requirements_of` make the tables of tessera.operators.constraints of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tessera.functions import versions as v

SCHEMA = "package string, version string, pos int, requirement string"
#: Nested records: package -> version -> requirement texts.
NESTED = "map<string,map<string,array<string>>>"


class Registry(Protocol):
    """What an external registry has to offer; it is pickled to the executors."""

    def versions(self, package: str) -> Iterable[str]: ...

    def dependencies(self, package: str, version: str) -> Iterable[str]: ...


@dataclass
class PackagePartition(InputPartition):
    """One package, asked for in one task."""

    package: str


class RegistryReader(DataSourceReader):
    """Asks for one package a partition; `packages` is what the filters leave of them."""

    def __init__(self, registry: Registry, packages: Iterable[str]) -> None:
        self.registry, self.packages = registry, sorted(set(packages))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes = and IN on package; Spark checks all others, which are given back."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("package",):
                self.packages = [p for p in self.packages if p == f.value]
            elif isinstance(f, In) and f.attribute == ("package",):
                self.packages = [p for p in self.packages if p in set(f.value)]
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [PackagePartition(p) for p in self.packages] or [PackagePartition("")]

    def read(self, partition: PackagePartition) -> Iterator[tuple]:
        if not partition.package:
            return
        for version in self.registry.versions(partition.package):
            asked = list(self.registry.dependencies(partition.package, version))
            for pos, requirement in enumerate(asked):
                yield partition.package, version, pos, requirement
            if not asked:
                yield partition.package, version, None, None


def source_of(registry: Registry, packages: Iterable[str]) -> type[DataSource]:
    """A data source named package_registry over `registry`, which cannot list its own packages."""
    known = list(packages)

    class PackageRegistry(DataSource):
        @classmethod
        def name(cls) -> str:
            return "package_registry"

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return RegistryReader(registry, known)

    return PackageRegistry


def ask(spark: SparkSession, packages: list[str] | None = None) -> DataFrame:
    """The registered source's rows of some packages, or of all."""
    table = spark.read.format("package_registry").load()
    return table if packages is None else table.where(F.col("package").isin(packages))


def from_nested(records: DataFrame, column: str) -> DataFrame:
    """The rows of nested records: a column of type NESTED, or of JSON text of that form; one record or many.

    A package that stands in several records has the releases of all of them; a release that does has all requirements.
    """
    nested = F.from_json(F.col(column), NESTED) if dict(records.dtypes)[column] == "string" else F.col(column)
    packages = records.select(F.explode(nested).alias("package", "releases"))
    releases = packages.select("package", F.explode("releases").alias("version", "asked"))
    return releases.select("package", "version", F.posexplode_outer("asked").alias("pos", "requirement"))


def nested(spark: SparkSession, data: dict[str, dict[str, list[str]]]) -> DataFrame:
    """The rows of a registry that is a nested dict of the driver."""
    return from_nested(spark.createDataFrame([(data,)], f"data {NESTED}"), "data")


def releases_of(rows: DataFrame) -> DataFrame:
    """package, version (parsed) of registry rows; rows whose version is none are an error of the registry and left to `problems`."""
    return rows.select("package", v.version(F.col("version")).alias("version")).where("version IS NOT NULL").distinct()


def requirements_of(rows: DataFrame) -> DataFrame:
    """package, version, pos, target, range of registry rows."""
    parsed = rows.where("requirement IS NOT NULL").select("package", v.version(F.col("version")).alias("version"), "pos", v.requirement(F.col("requirement")).alias("q"))
    return parsed.where("version IS NOT NULL AND q IS NOT NULL").select("package", "version", "pos", F.col("q.package").alias("target"), F.col("q.range").alias("range"))


def problems(rows: DataFrame) -> DataFrame:
    """package, version, problem: versions and requirements that cannot be parsed."""
    checked = rows.select("package", "version", F.array_compact(F.array(
        F.when(v.version(F.col("version")).isNull(), F.lit("no version")),
        F.when(F.col("requirement").isNotNull() & v.requirement(F.col("requirement")).isNull(), F.concat(F.lit("no requirement: "), F.col("requirement"))),
    )).alias("found"))
    return checked.select("package", "version", F.explode("found").alias("problem")).distinct()

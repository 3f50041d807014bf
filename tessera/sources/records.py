"""Small configuration records as one-row tables with a declared schema: TOML, and YAML where a parser is installed."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

try:
    import yaml
except ImportError:  # not part of the standard library
    yaml = None


def _fit(value, schema):
    """A parsed value with the fields of a schema: missing ones are null, others are left out."""
    if isinstance(schema, StructType):
        return None if value is None else {f.name: _fit(value.get(f.name), f.dataType) for f in schema.fields}
    return value


def _with_path(schema: StructType) -> StructType:
    return StructType([*StructType.fromDDL("path string").fields, *schema.fields])


def _parsed(spark: SparkSession, paths: str, schema: StructType, parse: Callable[[str], dict]) -> DataFrame:
    """One row for each file, however many there are; each is parsed in the task that reads it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{"path": path.as_py(), **_fit(parse(content.as_py().decode()), schema)} for path, content in zip(batch["path"], batch["content"], strict=True)]
            yield pa.RecordBatch.from_pylist(found, to_arrow_schema(whole))

    whole = _with_path(schema)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(rows, whole)


def read_toml(spark: SparkSession, paths: str, schema: StructType) -> DataFrame:
    """path and the schema's columns, one row for each file."""
    return _parsed(spark, paths, schema, tomllib.loads)


def read_yaml(spark: SparkSession, paths: str, schema: StructType) -> DataFrame:
    """path and the schema's columns, one row for each file."""
    if yaml is None:
        raise RuntimeError("no YAML parser is installed")
    return _parsed(spark, paths, schema, yaml.safe_load)

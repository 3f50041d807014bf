"""Readers and writers of check reports in JSON and JUnit XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "score double, threshold double, categories array<struct<name: string, weight: double, checks: array<struct<name: string, points: double, earned: double, detail: string>>>>"
TESTCASE = "_classname string, _name string, _time double, failure string, error string, skipped string"


def read_json_report(spark: SparkSession, path: str) -> DataFrame:
    """category, weight, name, points, earned, detail of each check of reports in JSON."""
    found = spark.read.schema(REPORT).option("multiLine", True).json(path).select(F.explode("categories").alias("c"))
    return found.select(F.col("c.name").alias("category"), "c.weight", F.explode("c.checks").alias("k")).select("category", "weight", "k.*")


def write_json_report(checks: DataFrame, path: str) -> None:
    """Reports in JSON from checks (category, weight, name, points, earned, detail), one for all of them."""
    inner = checks.groupBy("category", "weight").agg(F.sort_array(F.collect_list(F.struct("name", "points", "earned", "detail"))).alias("checks"))
    score = checks.groupBy("category", "weight").agg((F.sum("earned") / F.sum("points")).alias("f")).agg(F.sum(F.col("weight") * F.col("f"))).first()[0]
    report = inner.agg(F.sort_array(F.collect_list(F.struct(F.col("category").alias("name"), "weight", "checks"))).alias("categories"))
    report.select(F.lit(score).alias("score"), F.lit(1.0).alias("threshold"), "categories").coalesce(1).write.json(path)


def read_junit(spark: SparkSession, path: str) -> DataFrame:
    """classname, name, time, outcome (passed, failed, skipped) of the test cases of JUnit XML files."""
    rows = spark.read.format("xml").option("rowTag", "testcase").option("nullValue", "\u0000").schema(TESTCASE).load(path)
    broken = F.col("failure").isNotNull() | F.col("error").isNotNull()
    outcome = F.when(broken, "failed").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return rows.select(F.col("_classname").alias("classname"), F.col("_name").alias("name"), F.col("_time").alias("time"), outcome.alias("outcome"))


def junit_summary(cases: DataFrame) -> DataFrame:
    """total, broken and the sorted names of the broken ones; a skipped case is not broken."""
    name = F.concat_ws("::", "classname", "name")
    return cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") == "failed").alias("broken"), F.sort_array(F.collect_list(F.when(F.col("outcome") == "failed", name))).alias("names"))


def write_junit(cases: DataFrame, path: str) -> None:
    """JUnit XML files, with one row of `cases` for each test case."""
    failure = F.when(F.col("outcome") == "failed", "failed").alias("failure")
    skipped = F.when(F.col("outcome") == "skipped", "skipped").alias("skipped")
    rows = cases.select(F.col("classname").alias("_classname"), F.col("name").alias("_name"), F.col("time").alias("_time"), failure, skipped)
    rows.write.format("xml").option("rootTag", "testsuite").option("rowTag", "testcase").save(path)


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, size, mode, ok of each member of ZIP files; ok says whether its checksum holds."""
    import io
    import zipfile

    import pandas as pd

    def members(batches):
        for pdf in batches:
            out = []
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for i in z.infolist():
                        try:
                            good = z.read(i) is not None
                        except zipfile.BadZipFile:
                            good = False
                        out.append((archive, i.filename, i.file_size, i.external_attr >> 16 & 0o7777, good))
            yield pd.DataFrame(out, columns=["archive", "name", "size", "mode", "ok"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(members, "archive string, name string, size long, mode int, ok boolean")

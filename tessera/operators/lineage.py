"""Cutting of lineage in loops, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where everything runs in one local JVM
    may it be unset, which gives a folder on that machine; elsewhere that is an error, as a machine's own folder
    would lose data."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; it names the folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/tessera-shared"


def cut(df: DataFrame) -> DataFrame:
    """`df` checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()

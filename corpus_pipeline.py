"""The corpus pipeline: quality, exact copies, near copies, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; what a stage decides against is
gone for the next one. All stages but the last return the columns of `documents`; the last returns the token ids'
digests of the documents that are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, exact_dedup, quality, simhash
from tessera.llm.common import folders_made, release, shared_folder, written
from tessera.sources.tables import table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; the labels are those of `sf_dir`."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, at a similarity of 0.8 over five words, the document with the smallest id."""
    return simhash.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark of `sf_dir`."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document left."""
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("simhash", near_copies),
    ("decontaminate", benchmark_leaks),
    ("bpe", token_ids),
]

#: A learned model and fingerprints over XXH64 are not in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to `documents`; every stage's result is written as Parquet and read again, and its working folders go."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for name, stage in STAGES[:-1]:
        mark = folders_made()
        docs = written(stage(spark, docs, sf_dir), folder, name)
        release(spark, mark)
    return STAGES[-1][1](spark, docs, sf_dir)

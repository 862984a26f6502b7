"""A corpus pipeline over ``documents``: language ID, quality, near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import bin_completion, centroid_langid, poisson_mix, quality_mil, simhash_vptree
from gridspan.llm.common import DOCUMENT_COLUMNS, read_table, shared_dir, ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the nearest centroid rejects go."""
    ship(spark)
    return centroid_langid.identify_languages(docs, DOCUMENT_COLUMNS).filter("NOT rejected").select(*DOCUMENT_COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    ship(spark)
    return quality_mil.score_quality(docs, read_table(spark, sf_dir, "labels"), DOCUMENT_COLUMNS).filter(F.col("score") >= 0.3).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id."""
    ship(spark)
    return simhash_vptree.deduplicated(docs.select(*DOCUMENT_COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeated to their target weights (the square root of their size), shuffled."""
    return poisson_mix.poisson_mix(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1,024."""
    ship(spark)
    return bin_completion.pack_documents(docs)


STAGES = [("language_id", language_id), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The classifiers and the similarity search have no SQL form; brute-force versions test them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

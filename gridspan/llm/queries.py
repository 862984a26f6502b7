"""The thin ``opN_`` queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspan.llm import bin_completion, centroid_langid, line_frequency, multiset_hash, poisson_mix, quality_mil, rans_tokens, toxicity_fst, warc_derivatives
from gridspan.llm.common import DOCUMENT_COLUMNS, read_table
from gridspan.llm.simhash_vptree import near_duplicates


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = quality_mil.score_quality(docs, labels)
    return out.select("doc_id", quality_mil.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_passages", "top_passage")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix.poisson_mix(read_table(spark, sf_dir, "documents").select(*DOCUMENT_COLUMNS))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derivatives_of_pages(read_table(spark, sf_dir, "pages"))


def op4_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans_tokens.round_trip(read_table(spark, sf_dir, "documents"))


def op6_toxicity_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = toxicity_fst.score_toxicity(docs, labels)
    return out.select("doc_id", toxicity_fst.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_clauses")


def op7_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_documents(read_table(spark, sf_dir, "documents"))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.rule_documents(read_table(spark, sf_dir, "documents"))


def op9_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = centroid_langid.identify_languages(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", centroid_langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprint_pairs(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_mil": op1_quality_mil,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_simhash_vptree": op4_simhash_vptree,
    "op5_rans_tokens": op5_rans_tokens,
    "op6_toxicity_fst": op6_toxicity_fst,
    "op7_bin_completion": op7_bin_completion,
    "op8_line_frequency": op8_line_frequency,
    "op9_centroid_langid": op9_centroid_langid,
    "op10_multiset_hash": op10_multiset_hash,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {"op2_poisson_mix": poisson_mix.oracle_sql()}

"""The registered queries of this subpackage: name -> (builder, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoradesk.llm import (
    byte_bpe, fingerprints, identifiers, infill, languages, lexical, packing, quality, shingles, substrings, token_counts, topk, vectors,
)
from agoradesk.llm.shared import read_documents
from agoradesk.llm.sql import INFILL_SQL, JACCARD_SQL, LEXICAL_SQL, SUBSTRING_SQL, TOP_SQL, VECTOR_SQL


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("vec_id long, embedding array<float>, label int").parquet(f"{sf_dir}/embeddings.parquet")


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_embeddings(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(read_documents(spark, sf_dir))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digest(read_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_documents(spark, sf_dir))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_report(read_documents(spark, sf_dir))


def op6_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.identifier_report(read_documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.schema("doc_id long, quality int, toxic int").parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_report(read_documents(spark, sf_dir), labels)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(read_documents(spark, sf_dir))


def op10_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_components(read_documents(spark, sf_dir))


def op10_shingle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_links(read_documents(spark, sf_dir))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.schema("item_id long, text string").parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.ranked_search(read_documents(spark, sf_dir), items)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digest(read_documents(spark, sf_dir))


def op13_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_scores(_embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_vectors": (op1_vectors, VECTOR_SQL),
    "op2_fingerprints": (op2_fingerprints, None),
    "op3_byte_bpe": (op3_byte_bpe, None),
    "op4_packing": (op4_packing, None),
    "op5_languages": (op5_languages, None),
    "op6_identifiers": (op6_identifiers, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_quality": (op8_quality, None),
    "op9_substrings": (op9_substrings, SUBSTRING_SQL),
    "op10_shingles": (op10_shingles, JACCARD_SQL),
    "op10_shingle_links": (op10_shingle_links, None),
    "op11_lexical": (op11_lexical, LEXICAL_SQL),
    "op12_infill": (op12_infill, INFILL_SQL),
    "op13_top_vectors": (op13_top_vectors, TOP_SQL),
}

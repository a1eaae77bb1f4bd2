"""The corpus pipeline: language ID, near-duplicate removal, substring dedup, masking of personal data, packing.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoradesk.llm import identifiers, languages, packing, shingles, substrings
from agoradesk.llm.shared import read_documents, write_stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a text's letters that must be in spans of its main language; a text of no clear language is rejected.
LEAST_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or without a language that holds half of them, go; a missing ``lang`` is filled with the prediction.

    Where no document has a language to learn from, every text with a letter stays as it is.
    """
    model = languages.fit_languages(languages.training_rows(docs))
    if not model.names:
        return docs.select(*COLUMNS).where(F.col("text").rlike(r"\p{L}"))
    named = languages.predict_languages(docs.select(*COLUMNS), model)
    kept = named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one of the smallest id stays; documents of one id are told apart by their texts.

    Rows without an id come after all others of their group; of rows that are equal in id and text one stays.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    found = shingles.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"))
    groups = found.select(F.col("doc_id").alias("key"), "component_id").join(keyed.select("key", "doc_id").distinct(), "key")
    stay = groups.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "key")).alias("first")).select("first.key")
    return keyed.join(stay, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words and more that occur elsewhere are cut out; ``n_chars`` follows the text."""
    cut = substrings.dedup_texts(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def identifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked; ``n_chars`` follows the text."""
    masked = identifiers.mask_identifiers(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word of every document has a place in a training sequence."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("personal_data", identifier_stage),
    ("best_fit_packing", packing_stage),
]

#: The stages fit a model and search patterns iteratively, which SQL can't express; tests hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Rows out of JSON payloads, and last-write-wins / insert-if-absent merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agoradesk.functions.columns import first_match

# Batch size bounds.
MIN_BATCH, MAX_BATCH = 1, 32


def batch_status(payload: Column, schema: str, total: Column | None = None, index: str = "chunk_index", sized: bool = True) -> Column:
    """Status of a JSON array payload: type, size 1-32 (if ``sized``), and element indexes below ``total``."""
    size = F.json_array_length(payload)
    items = F.from_json(payload, f"array<{schema}>")
    low = lambda r: r[index].isNull() | (r[index] < 0)
    off = F.exists(items, low if total is None else lambda r: low(r) | (r[index] >= total))
    return first_match(
        (size.isNull(), "invalid_passage_batch"),
        (F.lit(sized) & ~size.between(MIN_BATCH, MAX_BATCH), "invalid_passage_batch_size"),
        (F.coalesce(off, F.lit(True)), "invalid_passage_index"),
        default="ok",
    )


def rows_from_json(df: DataFrame, column: str, schema: str, keep: list[str], total: Column | None = None) -> DataFrame:
    """Typed rows of the payloads whose elements are valid, whatever their number; ``batch_status`` reports the size beside it."""
    status = batch_status(F.col(column), schema, total, sized=False)
    return df.select(*keep, F.inline(F.when(status == "ok", F.from_json(column, f"array<{schema}>"))))


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Union of both with one row per key: the last of the batch, else the stored one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(c) for c in order])
    return both.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_new")


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, once each; append them to ``existing``."""
    return new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def to_json_documents(df: DataFrame, keys: list[str], name: str = "document") -> DataFrame:
    """Each row as one JSON text beside its keys."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias(name))

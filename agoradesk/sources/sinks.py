"""Sinks: append-only events, partition replacement, keyed merges into partitioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.session import shared_dir
from agoradesk.sources.rows import upsert


def append_events(df: DataFrame, path: str, ts: str = "created_at") -> None:
    """Append audit rows, partitioned by day; nothing is ever rewritten."""
    df.withColumn("event_date", F.to_date(ts)).write.mode("append").partitionBy("event_date").parquet(path)


def replace_partition(df: DataFrame, path: str, partition: list[str]) -> None:
    """Replace the partitions present in ``df`` (a re-ingested document's) and leave the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def merge_partition(batch: DataFrame, path: str, keys: list[str], order: list[str], partition: list[str]) -> None:
    """Upsert a batch into a partitioned table, reading and rewriting only the partitions it touches.

    The merged rows are written to the shared folder first, because a job
    cannot overwrite files it is still reading; a retried batch repeats both steps.
    """
    spark = batch.sparkSession
    stored = spark.read.schema(batch.schema).parquet(path)
    touched = batch.select(*partition).distinct()
    merged = upsert(stored.join(touched, partition, "left_semi"), batch, keys, order)
    staged = shared_dir(spark, "merge", uuid.uuid4().hex)
    merged.write.parquet(staged)
    replace_partition(spark.read.schema(batch.schema).parquet(staged), path, partition)

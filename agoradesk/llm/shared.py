"""Tables between steps, written below the folder that every executor can reach."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (a local session), a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="stages-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Bytes of a batch of documents that goes to a task's Python, for steps that gather much there; a batch is held on both sides.
BATCH_BYTES = 2_000_000
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def write_stage(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Write a step's rows and read them back: the plan behind is cut, and a lost executor costs only its own tasks.

    While they are written, a batch of rows that goes to Python is closed at ``batch_bytes``, where given; a longer row is one of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_LIMIT)
    try:
        if batch_bytes:
            spark.conf.set(BATCH_LIMIT, str(batch_bytes))
        df.write.parquet(path)
    finally:
        if batch_bytes:
            spark.conf.set(BATCH_LIMIT, before)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker is kept for later stages, and memory it only holds counts all the same."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    library = ctypes.CDLL(ctypes.util.find_library("c") or None)
    if hasattr(library, "malloc_trim"):
        library.malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a mapInArrow step; when its task ends, the memory it used is given back."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


_given_back = [0.0]


def tidy_groups(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The function of an applyInArrow step on tables without their key; at most once a second freed memory is given back."""

    def whole(table: pa.Table) -> pa.Table:
        out = run(table)
        if time.monotonic() - _given_back[0] > 1:
            give_back()
            _given_back[0] = time.monotonic()
        return out

    return whole


def tidy_keyed_groups(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """The same for functions that take a group's key."""

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        return tidy_groups(lambda t: run(key, t))(table)

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(spark: SparkSession) -> int:
    """Hash ranges of a corpus-wide count: a power of two, at least 256 and 4 per shuffle partition.

    A bucket is held by one task at a time, so ``spark.sql.shuffle.partitions`` bounds its memory: with one partition per 100 MB of
    text a bucket holds less than 10 million hashes at any size of the corpus.
    """
    n = 256
    while n < 4 * partitions(spark):
        n *= 2
    return n


def id_and_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text), whatever other columns the documents have."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def boxed(docs: DataFrame) -> DataFrame:
    """(row, id, text_hash): the documents as one struct column, so that no added column meets one of theirs."""
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
    )


def join_by_document(box: DataFrame, found: DataFrame) -> DataFrame:
    """Boxed documents with the columns of ``found`` (doc_id, text_hash and others), null where it has no row; equal rows all match."""
    found = found.withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash"))
    return box.join(found, same, "left").drop("id", "text_hash", "found_id", "found_hash")


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{sf_dir}/documents.parquet")


def is_remainder(column: str, divisor: int, remainder: int):
    """crc32(id as text) mod divisor = remainder; a null id is in no fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % divisor == remainder, F.lit(False))


def deal_blocks(rows: DataFrame, keys: list[str], by: str, size: int | Column) -> DataFrame:
    """Rows of each group dealt in blocks of about ``size``, and repeated so that every two blocks meet under (keys, low, high).

    Adds block, low and high. Groups of one row are left out: they have nobody to meet.
    """
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1")
    placed = rows.join(held, keys).withColumn("__blocks", F.ceil(F.col("__rows") / size).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(by), F.col("__blocks")).cast("int"))
    placed = placed.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return placed.withColumns({"low": F.least("block", "__other"), "high": F.greatest("block", "__other")}).drop("__rows", "__blocks", "__other")

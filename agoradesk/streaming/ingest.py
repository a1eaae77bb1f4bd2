"""Continuous ingestion: new documents become passages, exactly once per (document, passage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from agoradesk.operators.chunking import chunk_documents, passage_rows
from agoradesk.operators.ordered import latest_per_key
from agoradesk.session import shared_dir
from agoradesk.sources.sinks import replace_partition

BUCKETS = 256


def start_ingest(
    stream: DataFrame, path: str, name: str = "ingest", key: str = "doc_id", buckets: int = BUCKETS, version: str | None = None
) -> StreamingQuery:
    """Cut each micro-batch of (doc_id, title, text) and write it under its batch id.

    A batch that is retried replaces its own partition, so nothing is written
    twice; ``current_passages`` keeps the last batch of each document. Of several
    texts of a document in one batch the one of the highest ``version`` (a time or
    a number column) is kept. Without such a column their order is not known: the
    batch then keeps the greatest text, the same on every retry.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        newest = latest_per_key(batch, [key], [version, "text"] if version else ["text"])
        rows = passage_rows(chunk_documents(newest.select(key, "title", "text"), [key]), [key])
        rows = rows.withColumns({"batch": F.lit(batch_id), "bucket": F.pmod(F.xxhash64(key), F.lit(buckets))})
        replace_partition(rows, path, ["batch", "bucket"])

    return (
        stream.writeStream.foreachBatch(store).queryName(name).trigger(availableNow=True)
        .option("checkpointLocation", shared_dir(stream.sparkSession, "stream", name)).start()
    )


def current_passages(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Passages of the last batch that brought each document; older ones are superseded as a whole."""
    last = stored.groupBy(key).agg(F.max("batch").alias("batch"))
    return stored.join(last, [key, "batch"], "left_semi")

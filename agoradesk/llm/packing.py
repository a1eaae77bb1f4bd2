"""Variable-capacity best-fit packing of documents into training sequences.

Pieces are packed in decreasing length: each goes to the open bin it fills best, whatever the bin's size. Where none fits, the size that
costs least per word it can hold now is opened. In the end every bin shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.shared import partitions
from agoradesk.llm.words import slices, split_words

#: Permitted sequence lengths in words, and what opening a sequence of any length costs besides its length.
CAPACITIES = (512, 2048, 8192)
OVERHEAD = 32
PACKED = "shard int, bin int, capacity int, position int, doc_id long, piece int, start long, length int"


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset in the bin, capacity of each bin); lengths are 1 to the largest capacity, in decreasing order."""
    capacities = tuple(sorted(capacities))
    prefix = np.concatenate([[0], np.cumsum(lengths[::-1])]).tolist()  # words in the k shortest pieces
    rising = lengths[::-1]
    room: list[tuple[int, int]] = []  # (free words, bin) of open bins, ascending
    where, offset, used, size = [], [], [], []
    for k, length in enumerate(lengths):
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, own = room.pop(at)
        else:
            left = len(lengths) - k - 1
            own, free = len(used), _open(length, rising, prefix, left, capacities, overhead)
            used.append(0)
            size.append(free)
        where.append(own)
        offset.append(used[own])
        used[own] += length
        if free > length:
            insort(room, (free - length, own))
    fits = [capacities[bisect_left(capacities, u)] for u in used]
    return where, offset, fits


def _open(length: int, rising: list[int], prefix: list[int], left: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The size of least cost per word, if it is filled from the pieces that are left and fit beside this one."""
    best, price = capacities[-1], None
    for size in capacities:
        if size < length:
            continue
        others = prefix[min(left, bisect_left(rising, size - length + 1, 0, left))]
        cost = (size + overhead) / min(size, length + others)
        if price is None or cost < price:
            best, price = size, cost
    return best


def word_pieces(docs: DataFrame, longest: int, shards: int, count: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """(shard, doc_id, piece, start, length): each document cut into pieces of at most ``longest`` words; documents without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch["text"]):
                part = batch.slice(a, z - a)
                size = split_words(part["text"]).counts if count is None else count(part["text"])
                pieces = -(-size // longest)
                own = np.repeat(np.arange(z - a), pieces)
                number = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * longest
                yield pa.record_batch({
                    "shard": part["shard"].take(pa.array(own)), "doc_id": part["doc_id"].take(pa.array(own)), "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(np.minimum(size[own] - start, longest), pa.int32()),
                })

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(shards)).cast("int").alias("shard"),
    )
    return rows.mapInArrow(run, "shard int, doc_id long, piece int, start long, length int")


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, shards: int | None = None) -> DataFrame:
    """Every piece of every document with its place: shard and bin name a sequence, position is its first word there.

    A document longer than the largest capacity becomes several pieces (``start`` is the first word of each in the document). Documents are
    dealt to shards by a hash, and each shard is packed by itself, so no task grows with the corpus as long as
    ``spark.sql.shuffle.partitions`` does. Documents without words take no place; rows that repeat are packed as often as they come.
    """
    if not capacities or min(capacities) < 1 or overhead < 0:
        raise ValueError("capacities must be positive, the overhead 0 or more")
    longest = max(capacities)
    shards = shards or 2 * partitions(docs.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_pylist()
        where, offset, fits = pack_lengths(lengths, capacities, overhead)
        return pa.table({
            "shard": table["shard"], "bin": pa.array(where, pa.int32()), "capacity": pa.array([fits[b] for b in where], pa.int32()),
            "position": pa.array(offset, pa.int32()), "doc_id": table["doc_id"], "piece": table["piece"], "start": table["start"], "length": table["length"],
        })

    return word_pieces(docs, longest, shards).groupBy("shard").applyInArrow(run, PACKED)

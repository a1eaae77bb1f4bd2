"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, block by block. The tasks of a round count scores in the bins of an interval per query;
Spark adds the counts up, finds the bin that holds the k-th highest score, and the next round refines that bin. When bins are one
score wide the k-th value of every query is known; a last round keeps the scores that reach it, ties by the smaller id. Scores
are computed anew in each round, so none are stored and no group of equal scores meets in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agoradesk.llm.shared import write_stage

#: Vectors in a block; a task scores a block of queries against a block of vectors.
BLOCK_VECTORS = 4_096
#: Bins of a histogram: each round narrows a query's interval to one of them.
BINS = 1_024
#: Scores held at once in a task.
SCORES = 1_000_000
LONG_MOST = (1 << 63) - 1


def scaled_rows(vectors: DataFrame, is_query: Column, scale: int) -> DataFrame:
    """(row, vec_id, is_query, dims, values, squared): components as floor(scale · x); vectors that take no part are left out."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))))
    squared = F.aggregate("values", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    good = rows.where("embedding is not null").where(~bad).withColumn("values", whole)
    return good.select(F.monotonically_increasing_id().alias("row"), "vec_id", "is_query", F.size("values").alias("dims"), "values", squared.alias("squared"))


def dealt_pairs(rows: DataFrame, intervals: DataFrame, n_rows: int, n_queries: int) -> DataFrame:
    """Vectors and queries dealt by hash in blocks so that every block of queries meets every block of vectors under (dims, low, high).

    A vector is sent once per block of queries, a query once per block of vectors.
    """
    blocks, askers = -(-n_rows // BLOCK_VECTORS), -(-n_queries // BLOCK_VECTORS)
    none = F.lit(None).cast("long")
    held = rows.select(
        "dims", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("low"), F.explode(F.sequence(F.lit(0), F.lit(askers - 1))).alias("high"),
        "row", "vec_id", "values", none.alias("floor"), F.lit(False).alias("asks"),
    )
    asked = rows.where("is_query").join(intervals, "row").select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("low"), F.pmod(F.xxhash64("row"), F.lit(askers)).cast("int").alias("high"),
        "row", "vec_id", "values", "floor", F.lit(True).alias("asks"),
    )
    return held.unionAll(asked)


class _Block:
    """One block of queries against one block of vectors; scores come in strips of queries."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("row")
        asks = table["asks"].to_numpy()
        self.queries, self.held = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        self.dims = table["dims"][0].as_py()

    def _values(self, table: pa.Table) -> np.ndarray:
        flat = [c.flatten().to_numpy(zero_copy_only=False) for c in table["values"].chunks]
        return np.concatenate(flat).reshape(table.num_rows, self.dims) if flat else np.zeros((0, self.dims), np.int64)

    def strips(self):
        """(first query of the strip, scores as queries x vectors, whether each score counts)."""
        if not self.queries.num_rows or not self.held.num_rows:
            return
        asked, held = self._values(self.queries), self._values(self.held)
        most = float(np.abs(asked.astype(np.float64)).max(initial=0)) * float(np.abs(held.astype(np.float64)).max(initial=0)) * self.dims
        kind = np.float64 if most < 2.0**53 else object  # whole numbers up to 2^53 are exact in double precision
        asked, held = asked.astype(kind), held.astype(kind).T
        own, rows = self.queries["row"].to_numpy(), self.held["row"].to_numpy()
        step = max(1, SCORES // len(rows))
        for a in range(0, len(own), step):
            if self.dims:
                score = asked[a : a + step] @ held
                score = np.clip(score, -LONG_MOST - 1, LONG_MOST) if kind is object else score
            else:
                score = np.zeros((len(own[a : a + step]), len(rows)))
            yield a, score.astype(np.int64), own[a : a + step, None] != rows[None, :]


def _counter(span: int, width: int, k: int):
    """Counts per bin of ``width`` in each query's interval of ``span`` scores, a bin named by its lowest score. Of a block only bins down to its own k-th score matter: all others can only raise it."""

    def run(table: pa.Table) -> pa.Table:
        block, rows, places, counts = _Block(table), [], [], []
        floors, own = block.queries["floor"].to_numpy(), block.queries["row"].to_numpy()
        for a, score, counted in block.strips():
            floor = floors[a : a + len(score), None]
            with np.errstate(over="ignore"):
                above = (score - floor).astype(np.uint64)
            inside = counted & (score >= floor) & (above <= np.uint64(span - 1))
            place = np.where(inside, above // np.uint64(width), np.uint64(0)).astype(np.int64)
            place[~inside] = -1
            if place.shape[1] > k:
                least = np.partition(place, place.shape[1] - k, axis=1)[:, place.shape[1] - k]
                place[place < least[:, None]] = -1
            query, at = np.nonzero(place >= 0)
            bins = -(-span // width)
            key, number = np.unique(query * bins + place[query, at], return_counts=True)
            rows.append(own[a + key // bins])
            start = floors[a + key // bins].astype(np.uint64) + (key % bins).astype(np.uint64) * np.uint64(width)  # wraps to the right long
            places.append(start.astype(np.int64))
            counts.append(number)
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"row": join(rows), "floor": join(places), "n": join(counts)})

    return run


def narrowed(intervals: DataFrame, counts: DataFrame, lowest: int) -> DataFrame:
    """The bin of each query that holds its k-th score, and how many scores of it are still wanted.

    A query with fewer scores than it wants gets the lowest floor: all its scores reach it.
    """
    total = counts.groupBy("row", F.col("floor").alias("next")).agg(F.sum("n").alias("n"))
    reached = total.withColumn("above", F.sum("n").over(W.partitionBy("row").orderBy(F.desc("next"))))
    hit = reached.join(intervals, "row").where("above >= wanted and above - n < wanted").select(
        "row", "next", (F.col("wanted") - (F.col("above") - F.col("n"))).alias("left"),
    )
    return intervals.join(hit, "row", "left").select(
        "row", F.coalesce("next", F.lit(lowest)).alias("floor"), F.coalesce("left", "wanted").alias("wanted"),
    )


def _reacher(k: int):
    """Scores that reach the k-th value of their query: of one block at most the k first by score and id."""

    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        out = [(np.zeros(0, np.int64),) * 3]
        own, asked = block.queries["row"].to_numpy(), block.queries["vec_id"]
        floors = block.queries["floor"].to_numpy()
        ids = block.held["vec_id"].combine_chunks()
        no_id = ids.is_null().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        for a, score, counted in block.strips():
            query, at = np.nonzero(counted & (score >= floors[a : a + len(score), None]))
            value = score[query, at]
            order = np.lexsort((number[at], no_id[at], ~value, query))  # ~value falls as value rises, without overflow
            query, at, value = query[order], at[order], value[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            take = place < k
            out.append((query[take] + a, at[take], value[take]))
        query, at, value = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({
            "row": pa.array(own[query]), "query_id": asked.combine_chunks().take(pa.array(query)), "vec_id": ids.take(pa.array(at)),
            "score": pa.array(value, pa.int64()),
        })

    return run


def top_scores(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors of highest inner product for every row of ``vectors`` where ``is_query`` holds.

    ``vectors`` has vec_id and embedding. Components count as floor(scale · x), so scores are whole numbers; equal scores go to the
    smaller vec_id, null ids last. A vector is never its own candidate, but rows that repeat a vector or an id are vectors, and
    queries, of their own; vectors of another dimension do not meet. Vectors that are null or hold a null or a number that is
    not finite take no part; a score or component beyond the range of a long counts as its end.
    """
    if k < 1 or bins < 2:
        raise ValueError("k must be 1 or more, bins 2 or more")
    rows = write_stage(scaled_rows(vectors, is_query, scale), "scaled")
    held = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_query").alias("queries"), F.max("squared").alias("most"),
        F.max(F.when(F.col("is_query"), F.col("squared"))).alias("asked"),
    ).first()
    # no inner product exceeds the product of the norms
    bound = min(LONG_MOST + 1, math.ceil(min(2.0**63, math.sqrt(held["most"] or 0) * math.sqrt(held["asked"] or 0) * 1.000001)) + 1)
    intervals = rows.where("is_query").select("row", F.lit(-bound).cast("long").alias("floor"), F.lit(k).cast("long").alias("wanted"))
    deal = lambda: dealt_pairs(rows, intervals, max(held["n"], 1), max(held["queries"], 1)).groupBy("dims", "low", "high")
    span = min(2 * bound + 1, 1 << 64)
    while span > 1:
        width = -(-span // bins)
        counts = deal().applyInArrow(_counter(span, width, k), "row long, floor long, n long")
        intervals = write_stage(narrowed(intervals, counts, -LONG_MOST - 1), "intervals")
        span = width
    found = deal().applyInArrow(_reacher(k), "row long, query_id long, vec_id long, score long")
    place = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

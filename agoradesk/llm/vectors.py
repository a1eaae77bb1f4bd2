"""Embedding near-dedup: an exact metric range join.

On unit vectors cosine >= c means a distance of at most r = sqrt(2 - 2c). Every vector belongs to the cell of its nearest pivot; a vector
is also sent to every other cell whose border it may reach across: by the triangle inequality a partner's cell j satisfies
d(v, p_j) <= d(v, p_i) + 2 r, and in Euclidean space v is within r of the plane between the pivots. Cells then join independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.components import components
from agoradesk.llm.shared import deal_blocks, write_stage

#: Pivots per label, about. Labels with less than one in MOST_LABELS of all vectors are one cell, so pivots are bounded in number.
PIVOTS, MOST_LABELS = 12, 256
#: Bytes of vectors in a block, about; a task joins two blocks and holds so many cosines at once.
BLOCK_BYTES, COSINES = 8_000_000, 2_000_000
SLACK = 1e-9
CELLS = "label int, dims int, cell int, core boolean, number long, lead long, copies long, embedding array<double>"
FOUND = "number long, lead long, root long, links long"


def usable() -> Column:
    """Whether a row can link: it has an id, a label and a vector of finite numbers that are not all 0."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & some, F.lit(False))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Equal vectors of a label as one row: a number of its own, the smallest id and how many they are."""
    rows = vectors.groupBy("label", "embedding").agg(F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("copies"))
    number = F.monotonically_increasing_id().alias("number")  # rows of one id may hold several vectors
    return rows.select(number, "label", F.size("embedding").alias("dims"), "lead", "copies", "embedding")


def choose_pivots(distinct: DataFrame, pivots: int = PIVOTS) -> dict[tuple[int, int], np.ndarray]:
    """About ``pivots`` unit vectors per large (label, dimension), picked by a hash of the id; at most MOST_LABELS of those."""
    held = distinct.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("n"))
    total = held.agg(F.sum("n")).first()[0] or 0
    large = held.where(F.col("n") * MOST_LABELS > total)
    picked = distinct.join(large, ["label", "dims"]).where(F.pmod(F.xxhash64("lead"), F.lit(1_000_000_000)) * F.col("n") < F.lit(1_000_000_000 * pivots))
    out: dict[tuple[int, int], list] = {}
    for row in picked.select("label", "dims", "lead", "embedding").collect():
        out.setdefault((row["label"], row["dims"]), []).append((row["lead"], row["embedding"]))
    return {key: unit(np.array([v for _, v in sorted(rows)], dtype=np.float64)) for key, rows in out.items()}


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cell_matrix(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each vector, whether it goes to each cell)."""
    squared = np.maximum(2 - 2 * (x @ pivots.T), 0)
    own = squared.argmin(axis=1)
    nearest = squared[np.arange(len(x)), own][:, None]
    between = np.sqrt(np.maximum(2 - 2 * (pivots @ pivots.T), 0))[own]
    reach = np.sqrt(squared) <= np.sqrt(nearest) + 2 * radius + SLACK
    reach &= squared - nearest <= 2 * between * (radius + SLACK) + SLACK
    reach[np.arange(len(x)), own] = True
    return own, reach


def to_cells(distinct: DataFrame, pivots: dict, radius: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dims = batch["label"].to_numpy(), batch["dims"].to_numpy()
            for key in set(zip(label.tolist(), dims.tolist(), strict=True)):
                rows = np.flatnonzero((label == key[0]) & (dims == key[1]))
                part = batch.take(pa.array(rows))
                x = unit(part["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), key[1]))
                if key in pivots:
                    own, reach = cell_matrix(x, pivots[key], radius)
                    at, cell = np.nonzero(reach)
                    core = cell == own[at]
                else:
                    at, cell, core = np.arange(len(rows)), np.full(len(rows), -1), np.ones(len(rows), dtype=bool)
                sent = part.take(pa.array(at))
                values = pa.FixedSizeListArray.from_arrays(pa.array(x[at].ravel()), key[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch({
                    "label": sent["label"], "dims": sent["dims"], "cell": pa.array(cell, pa.int32()), "core": pa.array(core),
                    "number": sent["number"], "lead": sent["lead"], "copies": sent["copies"], "embedding": values,
                })

    return distinct.mapInArrow(run, CELLS)


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's group, after a[k] and b[k] were joined for every k; ``root`` has those from before."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def _joiner(cosine: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        same = key[3].as_py() == key[4].as_py()
        table = table.sort_by([("lead", "ascending"), ("number", "ascending")])
        block, core = table["block"].to_numpy(), table["core"].to_numpy()
        lead, copies = table["lead"].to_numpy(), table["copies"].to_numpy()
        x = np.concatenate([c.flatten().to_numpy() for c in table["embedding"].chunks]).reshape(len(lead), -1)
        root = np.arange(len(lead))
        links = np.zeros(len(lead), dtype=np.int64)
        step = max(1, COSINES // len(lead))
        for a in range(0, len(lead), step):
            near = x[a : a + step] @ x.T >= cosine
            near &= core[a : a + step, None] | core[None, :]
            if not same:
                near &= block[a : a + step, None] != block[None, :]
            at, to = np.nonzero(near)
            other = at + a != to
            at, to = at[other] + a, to[other]
            links += np.bincount(at, weights=copies[to], minlength=len(lead)).astype(np.int64)
            root = join_roots(root, at, to)
        show = core & ((links > 0) | (lead[root] != lead)) | (lead[root] != lead)
        return pa.table({
            "number": table["number"].filter(pa.array(show)), "lead": pa.array(lead[show]), "root": pa.array(lead[root][show]), "links": pa.array(np.where(core, links, 0)[show]),
        })

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Vectors link when they share a label and their cosine in double precision is at least ``cosine``. A vector that is null, zero, or holds
    a null or a number that is not finite, and one without label or id, links with nothing and keeps its own id. Rows that repeat count
    as vectors of their own; vectors of other dimension never link.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0, at most 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    good = rows.where(usable())
    distinct = write_stage(distinct_vectors(good), "vectors")
    cells = to_cells(distinct, choose_pivots(distinct), float(np.sqrt(2 - 2 * cosine)))
    dealt = deal_blocks(cells, ["label", "dims", "cell"], "number", F.ceil(F.lit(BLOCK_BYTES) / (8 * F.col("dims"))))
    found = write_stage(dealt.groupBy("label", "dims", "cell", "low", "high").applyInArrow(_joiner(cosine), FOUND), "vector_links")
    reached = components(found.select(F.col("lead").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "lead")
    links = found.groupBy("number").agg(F.sum("links").alias("links"))
    classes = distinct.join(links, "number", "left").join(reached, "lead", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "lead").alias("component_id"),
    )
    linked = good.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


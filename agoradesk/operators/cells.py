"""Exact vector search through a metric index: a question meets only cells that can still beat its k-th hit.

Passages of a tenant are cut into cells around centres; a cell knows its radius, the largest angle between its centre and a member. By
the triangle inequality on the sphere no member of a cell is nearer to a question than the angle to the centre less the radius, so the
cosine of that difference bounds every similarity in the cell. A question first visits its best cells; what it finds there is the
least that its k-th hit can score, and only cells whose bound reaches that are visited next. Cells are searched in blocks, so that a question
travels once per block and not once per cell. On vectors without any clusters bounds are all near 1 and every cell is met: then
:func:`agoradesk.operators.retrieval.search` makes the same products with less overhead.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoradesk.operators import retrieval as rt
from agoradesk.operators.ordered import top_per_key
from agoradesk.session import staged

#: Centres of a tenant at most; more passages make larger cells.
MOST_CELLS = 512
#: Passages that a question meets before its first bound is drawn, for each hit it wants.
FIRST_PASSAGES = 8
SLACK = 1e-9


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centres.T, -1.0, 1.0))


def _slices(rows: DataFrame, id_column: str, tenant: str, size: int) -> DataFrame:
    """Rows dealt by a hash of their id in slices of about ``size`` per tenant."""
    held = rows.groupBy(tenant).agg(F.ceil(F.count(F.lit(1)) / size).alias("_slices"))
    return rows.join(held, tenant).withColumn("_slice", F.pmod(F.xxhash64(id_column), F.col("_slices")))


def _with_centres(rows: DataFrame, centres: DataFrame, tenant: str) -> tuple:
    """Slices of rows, cogrouped with all centres of their tenant."""
    count = rows.select(tenant, "_slices").distinct()
    sent = centres.join(count, tenant).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1))).drop("_slices")
    sent = sent.withColumnRenamed(tenant, "_tenant")
    return rows.drop("_slices").groupBy(tenant, "_slice").cogroup(sent.groupBy("_tenant", "_slice"))


def build_index(passages: DataFrame, tenant: str = "institution_id", dimensions: int = 1_536) -> tuple[DataFrame, DataFrame]:
    """(passages with ``cell``, cells with centre, radius, number of passages and block), both written as tables.

    Cells that follow each other form a block of about the bytes a task may hold; a block with a larger cell is searched in several parts.
    Centres are passages, about as many as the square root of a tenant's number, chosen by a hash of their id; a passage belongs to the nearest.
    """
    rows = passages.select("passage_id", "document_id", tenant, F.col("embedding").cast("array<double>").alias("embedding"))
    size = rows.groupBy(tenant).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(tenant).orderBy(F.xxhash64("passage_id"), "passage_id")
    picked = rows.withColumn("cell", F.row_number().over(order)).where(F.col("cell") <= MOST_CELLS)
    picked = picked.join(size, tenant).where(F.col("cell") <= F.ceil(F.sqrt("_n")))
    centres = staged(picked.select(tenant, "cell", F.col("embedding").alias("centre")), "centres")

    def assign(own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own[columns].iloc[:0].assign(cell=np.zeros(0, np.int32), angle=np.zeros(0))
        around = around.sort_values("cell")
        x, centre = _units(own["embedding"]), _units(around["centre"])
        at, angle = np.empty(len(own), np.int64), np.empty(len(own))
        for i in range(0, len(own), 4_096):
            turned = _angles(x[i : i + 4_096], centre)
            at[i : i + 4_096], angle[i : i + 4_096] = turned.argmin(axis=1), turned.min(axis=1)
        return own[columns].assign(cell=around["cell"].to_numpy()[at], angle=angle)

    columns = rows.columns
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    room = max(1, rt._CELL_BYTES // (8 * dimensions))
    held = staged(_with_centres(_slices(rows, "passage_id", tenant, room), centres, tenant).applyInPandas(assign, f"{kinds}, cell int, angle double"), "cells")
    cells = held.groupBy(tenant, "cell").agg(F.count(F.lit(1)).alias("passages"), F.max("angle").alias("radius"))
    # A tenant has few cells, so this window is short.
    before = F.sum("passages").over(Window.partitionBy(tenant).orderBy("cell")) - F.col("passages")
    blocks = cells.withColumn("block", F.floor(before / room).cast("int"))
    parts = F.ceil(F.sum("passages").over(Window.partitionBy(tenant, "block")) / room)
    return held, staged(blocks.withColumn("parts", parts).join(centres, [tenant, "cell"]), "radii")


def _visitor(first: bool, wanted: int, columns: list[str]):
    """Cells a question visits, a list per block: the best ones until they hold enough passages, or of all others those that reach its floor."""

    def visits(own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(around):
            return own[columns].iloc[:0].assign(block=np.zeros(0, np.int32), cells=pd.Series([], dtype=object))
        around = around.sort_values("cell")
        bound = np.cos(np.maximum(_angles(_units(own["embedding"]), _units(around["centre"])) - around["radius"].to_numpy(), 0.0))
        order = np.argsort(-bound, axis=1, kind="stable")
        held = np.cumsum(around["passages"].to_numpy()[order], axis=1)
        early = held - around["passages"].to_numpy()[order] < wanted
        take = early if first else ~early & (np.take_along_axis(bound, order, axis=1) >= own["floor"].to_numpy()[:, None] - SLACK)
        row, place = np.nonzero(take)
        met = order[row, place]
        block = around["block"].to_numpy()[met]
        by = np.lexsort((block, row))  # stable: the cells of a block stay best first
        row, block, cell = row[by], block[by], around["cell"].to_numpy()[met[by]]
        start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (block[1:] != block[:-1])]) if len(row) else row
        out = own[columns].iloc[row[start]].reset_index(drop=True)
        return out.assign(block=block[start], cells=pd.Series(np.split(cell, start[1:]) if len(start) else [], dtype=object))

    return visits


def _visit(asked: DataFrame, cells: DataFrame, tenant: str, first: bool, wanted: int) -> DataFrame:
    columns = ["question_id", tenant, "embedding", "floor"]
    kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in columns)
    sliced = _slices(asked, "question_id", tenant, rt._CELL_QUESTIONS)
    return _with_centres(sliced, cells, tenant).applyInPandas(_visitor(first, wanted, columns), f"{kinds}, block int, cells array<int>")


def _best_in_block(k: int, per_document: int, minimum: float):
    """Best hits of each question among the cells it visits in a block; of passages that meet several questions one product is made."""

    def best(questions: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(questions) and len(passages):
            passages = passages.sort_values("cell", kind="stable")
            ids, docs, matrix = passages["passage_id"].to_numpy(), passages["document_id"].to_numpy(), _units(passages["embedding"])
            known, sizes = np.unique(passages["cell"].to_numpy(), return_counts=True)
            asked, names = _units(questions["_vector"]), questions["question_id"].to_numpy()
            least = np.maximum(questions["_floor"].to_numpy() - SLACK, minimum)
            wants = np.stack([np.isin(known, own) for own in questions["_cells"]])
            alike = np.argsort([own[0] for own in questions["_cells"]], kind="stable")
            for at in range(0, len(alike), 64):
                rows = alike[at : at + 64]
                met = wants[rows].any(axis=0)
                if not met.any():
                    continue
                near = slice(None) if met.all() else np.flatnonzero(np.repeat(met, sizes))
                scores = asked[rows] @ matrix[near].T
                own = wants[rows][:, met]
                if not own.all():
                    scores[~np.repeat(own, sizes[met], axis=1)] = -np.inf
                some_ids, some_docs = ids[near], docs[near]
                for row, i in zip(scores, rows):
                    found += [(names[i], some_ids[j], some_docs[j], row[j]) for j in rt._pick(row, some_ids, some_docs, k, per_document, least[i])]
        return pd.DataFrame(found, columns=["question_id", "passage_id", "document_id", "similarity"])

    return best


def _meet(visits: DataFrame, held: DataFrame, cells: DataFrame, tenant: str, k: int, per_document: int, minimum: float) -> DataFrame:
    """Hits of the visits: a question travels once to each part of a block, whatever the number of cells it visits there."""
    asks = visits.groupBy(tenant, "block").agg(F.ceil(F.count(F.lit(1)) / rt._CELL_QUESTIONS).alias("_qn"))
    plan = asks.join(cells.groupBy(tenant, "block").agg(F.max("parts").alias("_pn")), [tenant, "block"])
    places = cells.select(tenant, "cell", "block").join(plan, [tenant, "block"])
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = visits.join(plan, [tenant, "block"]).select(
        "question_id", F.col(tenant).alias("_qt"), F.col("block").alias("_qb"), F.col("embedding").alias("_vector"), F.col("cells").alias("_cells"),
        F.col("floor").alias("_floor"), F.pmod(F.xxhash64("question_id"), F.col("_qn")).alias("_qq"), copies("_pn").alias("_qp"))
    kept = held.join(places, [tenant, "cell"]).select(
        "passage_id", "document_id", tenant, "cell", "block", "embedding", F.pmod(F.xxhash64("passage_id"), F.col("_pn")).alias("_p"), copies("_qn").alias("_q"))
    types = {f.name: f.dataType.simpleString() for f in [*visits.schema.fields, *held.schema.fields]}
    schema = ", ".join(f"{c} {types[c]}" for c in ("question_id", "passage_id", "document_id")) + ", similarity double"
    pairs = asked.groupBy("_qt", "_qb", "_qp", "_qq").cogroup(kept.groupBy(tenant, "block", "_p", "_q"))
    return pairs.applyInPandas(_best_in_block(k, per_document, minimum), schema)


def search_index(
    questions: DataFrame, index: tuple[DataFrame, DataFrame], k: int = 8, per_document: int = 3, minimum: float = 0.0, tenant: str = "institution_id",
    dimensions: int = 1_536,
) -> tuple[DataFrame, DataFrame]:
    """(hits, visits): the same hits as the search over all passages, and which cells each question met.

    A cap per document only takes lower hits in, so the k-th capped score over part of the passages is never above the final one; cells whose
    bound stays below it hold no hit.
    """
    held, cells = index
    asked = questions.select("question_id", tenant, F.col("embedding").cast("array<double>").alias("embedding"))
    order = [F.desc("similarity"), F.asc("passage_id")]
    best = lambda hits: top_per_key(top_per_key(hits, ["question_id", "document_id"], order, per_document), ["question_id"], order, k, "rank")
    wanted = FIRST_PASSAGES * k
    first = staged(_visit(asked.withColumn("floor", F.lit(float(minimum))), cells, tenant, True, wanted), "visits")
    early = staged(best(_meet(first, held, cells, tenant, k, per_document, minimum)), "early")
    floors = early.where(F.col("rank") == k).select("question_id", F.col("similarity").alias("floor"))
    bounded = asked.join(floors, "question_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float(minimum))))
    second = staged(_visit(bounded, cells, tenant, False, wanted), "visits")
    late = _meet(second, held, cells, tenant, k, per_document, minimum)
    hits = best(early.drop("rank").unionByName(late))
    return hits, first.unionByName(second).select("question_id", tenant, F.explode("cells").alias("cell"))


def compared_share(visits: DataFrame, questions: DataFrame, cells: DataFrame, tenant: str = "institution_id") -> DataFrame:
    """compared and possible pairs of questions and passages, and their share, per tenant."""
    met = visits.join(cells.select(tenant, "cell", "passages"), [tenant, "cell"]).groupBy(tenant).agg(F.sum("passages").alias("compared"))
    asked = questions.groupBy(tenant).agg(F.count(F.lit(1)).alias("_q"))
    size = cells.groupBy(tenant).agg(F.sum("passages").alias("_p"))
    rows = met.join(asked, tenant).join(size, tenant)
    return rows.select(tenant, "compared", (F.col("_q") * F.col("_p")).alias("possible"), (F.col("compared") / (F.col("_q") * F.col("_p"))).alias("share"))

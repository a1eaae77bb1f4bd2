"""Ranked lexical search of many items at once, with shared term sets evaluated once.

1. Items are mined for shared term sets: terms that stand in the same items are one set; then pairs of sets that several items share
   become a new set, round by round. The result is a graph: a set is a term or the sum of two sets, an item the sum of some.
2. One pass over the documents keeps, of each, its length and how often it holds the items' terms. Spark counts documents, lengths and
   document frequencies from that table.
3. Each set's partial scores are computed once per document, level by level along the graph, whichever number of items share them. A task
   keeps the best documents of each item; Spark ranks those of all tasks.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from agoradesk.llm.shared import id_and_text, write_stage
from agoradesk.llm.words import Words, byte_runs, lower_ascii, slices, span_array, text_bytes

#: Bytes of item texts in a block. A block's terms and graph are held by the driver and every task; each block is a pass over the documents.
ITEM_BYTES = 4_000_000
#: Partial scores held at once in a task.
CELLS = 4_000_000
#: Sets of an item, the most shared ones first, that each set is paired with: keeps the mining of long items linear.
NEIGHBOURS = 64
# Fixed values of the score: 1000 · ln in the weight, k1 = 1.2 and b = 0.25 in thousandths.
GAIN, K1, B_PERCENT = 1_000_000_000, 12, 25
POSTINGS = "doc_id long, n long, terms array<int>, times array<int>"


def split_terms(texts: pa.Array) -> Words:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    return byte_runs(data, offsets, (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)))


@dataclass
class SharingPlan:
    """Which sets of terms are summed once, and which sets make up each item."""

    vocabulary: list[bytes]
    leaf_term: np.ndarray  # per leaf: its term
    leaf_times: np.ndarray  # and how often the items of that leaf repeat it
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # sets of a level, left part, right part
    parts: list[list[int]]  # sets of each item

    @property
    def nodes(self) -> int:
        return len(self.leaf_term) + sum(len(made) for made, _, _ in self.levels)

    @property
    def additions(self) -> int:
        """Additions per document with the shared sets; without them an item of n terms takes n - 1."""
        return self.nodes - len(self.leaf_term) + sum(max(len(p) - 1, 0) for p in self.parts)


def mine_shared_sets(items: list[list[bytes]]) -> SharingPlan:
    """The sharing graph of items given as lists of terms with repeats."""
    held = [Counter(terms) for terms in items]
    vocabulary = sorted({t for own in held for t in own})
    number = {t: k for k, t in enumerate(vocabulary)}
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for item, own in enumerate(held):
        for term, times in own.items():
            holders[number[term], times].append(item)
    leaves = sorted(holders)
    same: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for leaf, key in enumerate(leaves):
        same[tuple(holders[key])].append(leaf)
    made: list[tuple[int, int]] = []
    first = len(leaves)

    def add(left: int, right: int) -> int:
        made.append((left, right))
        return first + len(made) - 1

    # terms of the same items are one set, summed as a balanced tree; sets of many items come first in every item
    parts: list[list[int]] = [[] for _ in items]
    for who in sorted(same, key=lambda w: (-len(w), w)):
        row = same[who]
        while len(row) > 1:
            row = [add(*row[k : k + 2]) if k + 1 < len(row) else row[k] for k in range(0, len(row), 2)]
        for item in who:
            parts[item].append(row[0])
    while True:
        seen = Counter(pair for own in parts for pair in _near(own))
        shared = {pair: n for pair, n in seen.items() if n > 1}
        if not shared:
            break
        taken: Counter = Counter()
        chosen = [_pairs_of(own, shared) for own in parts]
        for own in chosen:
            taken.update(own)
        names = {pair: add(*pair) for pair in sorted(taken) if taken[pair] > 1}
        if not names:
            break
        for item, own in enumerate(chosen):
            gone = {x for pair in own if pair in names for x in pair}
            parts[item] = [names[pair] for pair in own if pair in names] + [x for x in parts[item] if x not in gone]
    return SharingPlan(
        vocabulary, np.array([t for t, _ in leaves], dtype=np.int64), np.array([r for _, r in leaves], dtype=np.int64), _levels(first, made), parts
    )


def _near(own: list[int]) -> Iterator[tuple[int, int]]:
    for k, left in enumerate(own):
        for right in own[k + 1 : k + 1 + NEIGHBOURS]:
            yield min(left, right), max(left, right)


def _pairs_of(own: list[int], shared: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Pairs without a common set, those of most items first; ties by their numbers, so that items choose alike."""
    used: set[int] = set()
    out = []
    for pair in sorted((p for p in _near(own) if p in shared), key=lambda p: (-shared[p], p)):
        if not used & set(pair):
            used.update(pair)
            out.append(pair)
    return out


def _levels(first: int, made: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    depth: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, (left, right) in enumerate(made):
        depth[first + k] = 1 + max(depth.get(left, 0), depth.get(right, 0))
        rows[depth[first + k]].append((first + k, left, right))
    return [tuple(np.array(x, dtype=np.int64) for x in zip(*rows[d], strict=True)) for d in sorted(rows)]


def postings(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, times) of every document: all its terms counted, and those of ``vocabulary`` with their numbers of occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_binary())
        for batch in batches:
            for a, z in slices(batch["text"]):
                part = batch.slice(a, z - a)
                words = split_terms(part["text"])
                n = words.counts
                term = pc.index_in(span_array(words.data, words.start, words.end), value_set=known)
                hit = term.is_valid().to_numpy(zero_copy_only=False)
                key = words.text_of_word()[hit] * max(len(vocabulary), 1) + term.drop_null().to_numpy()
                key, times = np.unique(key, return_counts=True)
                doc = key // max(len(vocabulary), 1)
                offsets = pa.array(np.searchsorted(doc, np.arange(z - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % max(len(vocabulary), 1), times)]
                yield pa.record_batch([part["doc_id"], pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    return id_and_text(docs).mapInArrow(run, POSTINGS)


def term_weights(n_docs: int, frequency: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], dtype=np.int64)


def length_terms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of each document: 75 + 25 · n · N div L, exact beyond 64 bits too."""
    if int(n.max(initial=0)) * B_PERCENT * n_docs < 1 << 63:
        return 100 - B_PERCENT + B_PERCENT * n * n_docs // total
    return np.array([100 - B_PERCENT + B_PERCENT * int(x) * n_docs // total for x in n], dtype=np.int64)


class Scorer:
    """Partial scores of a plan's sets, and the best documents of each item so far."""

    def __init__(self, plan: SharingPlan, weights: np.ndarray, n_docs: int, total: int, k: int):
        self.plan, self.n_docs, self.total, self.k = plan, n_docs, total, k
        self.weight = weights[plan.leaf_term] * plan.leaf_times
        self.some = np.array([i for i, p in enumerate(plan.parts) if p], dtype=np.int64)
        self.flat = np.array([s for i in self.some for s in plan.parts[i]], dtype=np.int64)
        size = np.array([len(plan.parts[i]) for i in self.some], dtype=np.int64)
        self.first = np.cumsum(size) - size
        self.least = np.ones(len(self.some), dtype=np.int64)  # a document below this cannot be among an item's best
        self.best = [np.zeros(0, np.int64)] * 4  # item, score, id, whether the id is null

    def step(self) -> int:
        """Documents scored at once."""
        return max(1, CELLS // max(self.plan.nodes + len(self.flat), 1))

    def scores(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> np.ndarray:
        """items x documents, of the items that have terms."""
        plan = self.plan
        length = length_terms(n, self.n_docs, self.total)[doc]
        times = times.astype(np.int64)
        impact = np.zeros((len(plan.vocabulary), len(n)), dtype=np.int64)
        impact[term, doc] = GAIN * times // (1000 * times + K1 * length)
        sums = np.empty((plan.nodes, len(n)), dtype=np.int64)
        sums[: len(plan.leaf_term)] = impact[plan.leaf_term] * self.weight[:, None]
        for made, left, right in plan.levels:
            sums[made] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.flat], self.first, axis=0)

    def add(self, ids: pa.Array, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray) -> None:
        if not len(self.some):
            return
        score = self.scores(n, doc, term, times)
        item, at = np.nonzero(score >= self.least[:, None])
        found = item, score[item, at], ids.fill_null(0).to_numpy(zero_copy_only=False)[at], ids.is_null().to_numpy(zero_copy_only=False)[at].astype(np.int64)
        both = [np.concatenate(x) for x in zip(self.best, found, strict=True)]
        order = np.lexsort((both[2], both[3], -both[1], both[0]))
        both = [x[order] for x in both]
        place = np.arange(len(order)) - np.searchsorted(both[0], both[0])
        self.best = [x[place < self.k] for x in both]
        last = place == self.k - 1
        self.least[both[0][last]] = both[1][last]

    def rows(self) -> pa.RecordBatch:
        item, score, ids, null = self.best
        return pa.record_batch({
            "item": pa.array(self.some[item], pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "score": pa.array(score, pa.int64()),
        })


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """(item_id, item, doc_id, score): at most k documents per item and task, for one block of items."""
    spark = docs.sparkSession
    words = split_terms(pa.array([row["text"] for row in items], pa.string()))
    terms = span_array(words.data, words.start, words.end).to_pylist()
    plan = mine_shared_sets([terms[a:z] for a, z in zip(words.first[:-1], words.first[1:], strict=True)])
    if not plan.vocabulary:
        return None
    held = write_stage(postings(docs, plan.vocabulary), "postings")
    size = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    counted = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    frequency = np.zeros(len(plan.vocabulary), dtype=np.int64)
    for row in counted.collect():  # one row per term of the block at most
        frequency[row["term"]] = row["df"]
    weights = term_weights(size["docs"], frequency)
    n_docs, total = size["docs"], max(size["total"], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(plan, weights, n_docs, total, k)
        step = scorer.step()
        for batch in batches:
            n = batch["n"].to_numpy()
            for a in range(0, len(n), step):
                part = batch.slice(a, min(step, len(n) - a))
                count = pc.list_value_length(part["terms"]).to_numpy()
                scorer.add(
                    part["doc_id"], n[a : a + step], np.repeat(np.arange(part.num_rows), count), part["terms"].flatten().to_numpy(),
                    part["times"].flatten().to_numpy(),
                )
        yield scorer.rows()

    found = held.where(F.size("terms") > 0).mapInArrow(run, "item long, doc_id long, score long")
    names = spark.createDataFrame([(k, row["item_id"]) for k, row in enumerate(items)], "item long, item_id long")
    return found.join(names, "item")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text).

    Scores are whole numbers of the BM25 family; a document without any of an item's terms is not listed, equal scores go to the smaller
    doc_id (null last). Null and empty texts have no terms. Rows of ``docs`` that repeat an id or a text are documents of their own, and
    rows of ``items`` items of their own. Items are searched in blocks of about 4 MB of text; the documents are read once per block.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = size // ITEM_BYTES + 1
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for block in range(blocks):
        rows = asked.where(own == block).orderBy("item_id", "text").collect()  # one block, bounded in bytes
        part = _search_block(docs, rows, k) if rows else None
        if part is not None:
            found.append(part.withColumn("block", F.lit(block)))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    all_found = found[0]
    for part in found[1:]:
        all_found = all_found.unionByName(part)
    place = F.row_number().over(W.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return all_found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")

"""Document fingerprints: SimHash over weighted term hashes, and permuted block tables for the search by Hamming distance.

Terms are pairs of neighbouring words (the word itself, if a text has one only), weighted by 1 + ln(frequency). Every term votes on 64
bits with its hash; a bit is set where the weighted votes for it win.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agoradesk.llm.shared import deal_blocks, id_and_text, partitions, write_stage
from agoradesk.llm.words import BASE, mix, slices, split_words

BITS = 64
#: Terms whose bits are spread out at once.
TERMS_AT_ONCE = 40_000
#: Hamming radius of the search, and blocks a fingerprint is cut into: one table for every choice of blocks - radius equal ones.
RADIUS, BLOCKS = 3, 5
BLOCK_PRINTS = 1024
REPORT = (
    "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double, text string"
)


def simhash(texts: pa.Array) -> np.ndarray:
    """64-bit fingerprint of each text; a text without words has 0."""
    out = [np.zeros(0, np.uint64)]
    for a, z in slices(texts):
        words = split_words(texts.slice(a, z - a))
        code, doc = words.hashes(), words.text_of_word()
        pair = np.zeros(len(code), dtype=bool)
        pair[:-1] = doc[1:] == doc[:-1]
        single = words.counts[doc] == 1 if len(doc) else pair
        term = code.copy()
        term[:-1] = np.where(pair[:-1], code[:-1] * BASE + code[1:], code[:-1])
        keep = pair | single
        out.append(_vote(mix(term[keep]), doc[keep], z - a))
    return np.concatenate(out)


def _vote(term: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        term[a:z].sort()
    first = np.ones(len(term), dtype=bool)
    first[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    weight = (1 + np.log(np.diff(np.append(at, len(term))))).astype(np.float32)
    term, doc = term[at], doc[at]
    votes = np.zeros((n, BITS), dtype=np.float64)
    for a in range(0, len(term), TERMS_AT_ONCE):
        own, w = doc[a : a + TERMS_AT_ONCE], weight[a : a + TERMS_AT_ONCE]
        bits = np.unpackbits(term[a : a + TERMS_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        bits *= 2 * w[:, None]
        bits -= w[:, None]
        begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        votes[own[begin]] += np.add.reduceat(bits, begin, axis=0)
    return np.packbits(votes > 1e-6, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def _report(ids: list, texts: list[str], following: list[str], following_prints: np.ndarray | None = None) -> dict:
    """Result columns of documents and their next ones."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    own = simhash(pa.array(texts, pa.large_string()))
    changed = simhash(pa.array(edited, pa.large_string()))
    after = simhash(pa.array(following, pa.large_string())) if following_prints is None else np.concatenate([own[1:], following_prints])
    n = len(ids)
    return {
        "kind": pa.array([0] * n, pa.int32()), "part": pa.array([0] * n, pa.int32()), "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        "fingerprint": pa.array([f"{x:016x}" for x in own.tolist()], pa.string()),
        "edited_fingerprint": pa.array([f"{x:016x}" for x in changed.tolist()], pa.string()),
        "near_edited": pa.array(likeness(own, changed)), "near_next": pa.array(likeness(own, after)), "text": pa.array([None] * n, pa.string()),
    }


def _border(kind: int, part: int, doc: int | None, text: str) -> pa.RecordBatch:
    row = {
        "kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "doc_id": pa.array([doc], pa.int64()), "n_chars": pa.array([None], pa.int64()),
        **{k: pa.array([None], pa.string()) for k in ("edited_sha256", "fingerprint", "edited_fingerprint")},
        **{k: pa.array([None], pa.float64()) for k in ("near_edited", "near_next")}, "text": pa.array([text], pa.string()),
    }
    return pa.record_batch(row)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a partition in their order: each against the next; the first and the last one are handed on for the borders."""
    part = TaskContext.get().partitionId()
    ids: list = []
    texts: list[str] = []
    begun = False
    for batch in batches:
        for a, z in slices(batch["text"]):
            piece = batch.slice(a, z - a)
            if not begun:
                begun = True
                yield _border(1, part, piece["doc_id"][0].as_py(), piece["text"][0].as_py() or "")
            ids += piece["doc_id"].to_pylist()
            texts += piece["text"].fill_null("").to_pylist()
            if len(ids) > 1:
                last = simhash(pa.array(texts[-1:], pa.large_string()))
                yield pa.record_batch(_report(ids[:-1], texts[:-1], texts[1:], last))
                ids, texts = ids[-1:], texts[-1:]
    if ids:
        yield _border(2, part, ids[0], texts[0])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.record_batch(_report(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["next_text"].to_pylist()))


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(fingerprint, n_near): for each value of ``fingerprint`` (16 hex digits) the other rows within ``radius`` bits of it.

    Two fingerprints within the radius agree in at least blocks - radius blocks, so they meet in the table of those blocks; where they
    meet in several, the first counts. Equal fingerprints are one row with a count; a crowded key is dealt in blocks.
    """
    if not 0 <= radius < blocks <= 16:
        raise ValueError("radius must be below the number of blocks")
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (bounds[b + 1] - bounds[b])) - 1) << bounds[b] for b in own) for own in combinations(range(blocks), blocks - radius)]
    held = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    value = held.withColumn("value", F.conv("fingerprint", 16, -10).cast("long"))
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = value.select("value", "copies", F.posexplode(F.array(*(F.col("value").bitwiseAND(F.lit(m)) for m in signed))).alias("table", "key"))
    met = keyed.withColumn("met", F.count(F.lit(1)).over(Window.partitionBy("table", "key"))).where("met > 1").drop("met")
    dealt = deal_blocks(met, ["table", "key"], "value", BLOCK_PRINTS)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        table, same = key[0].as_py(), key[2].as_py() == key[3].as_py()
        x, copies, block = rows["value"].to_numpy().view(np.uint64), rows["copies"].to_numpy(), rows["block"].to_numpy()
        near = np.zeros(len(x), dtype=np.int64)
        earlier = np.array(masks[:table], dtype=np.uint64)
        for a in range(0, len(x), 256):
            apart = x[a : a + 256, None] ^ x[None, :]
            hit = (np.bitwise_count(apart) <= radius) & (apart != 0)
            if not same:
                hit &= block[a : a + 256, None] != block[None, :]
            for mask in earlier:
                hit &= (apart & mask) != 0
            near[a : a + 256] = (hit * copies[None, :]).sum(axis=1)
        return pa.table({"value": pa.array(x.view(np.int64)), "near": pa.array(near)})

    found = dealt.groupBy("table", "key", "low", "high").applyInArrow(run, "value long, near long")
    total = found.groupBy("value").agg(F.sum("near").alias("near"))
    return value.join(total, "value", "left").select("fingerprint", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_near"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with ``fingerprint`` as 16 hex digits; a null text counts as empty and has 0."""
    rest = docs.drop("fingerprint")
    names = rest.columns
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rest.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([f"{x:016x}" for x in simhash(batch["text"]).tolist()], pa.string())
            yield pa.record_batch([*(batch[n] for n in names), own], names=[*names, "fingerprint"])

    return rest.mapInArrow(run, columns + "fingerprint string")


def edit_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text edited with the next one's, and how alike they are.

    The next document is that of the next smaller id (of equal ids in a fixed order of their texts; documents without id come last); after
    the last comes the first. The documents are sorted once by ranges of ids; only the two documents at each border between ranges are
    handled apart. ``n_near`` is the number of other documents within ``RADIUS`` bits of the fingerprint.
    """
    rows = id_and_text(docs)
    order = F.col("doc_id").desc_nulls_last()
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), order).sortWithinPartitions(order, F.xxhash64("text"))
    done = write_stage(ranged.mapInArrow(_walk, REPORT), "fingerprints")
    first = done.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    last = done.where("kind = 2").select("part", "doc_id", "text")
    ring = last.select("part")
    after = ring.withColumn("next_part", F.lead("part").over(Window.orderBy("part"))).withColumn("next_part", F.coalesce("next_part", F.min("part").over(Window.partitionBy())))
    border = last.join(after, "part").join(first, "next_part").select("doc_id", "text", "next_text")
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    report = done.where("kind = 0").select(*names).unionAll(border.mapInArrow(_pairs, REPORT).select(*names))
    return report.join(near_counts(report.select("fingerprint")), "fingerprint").select(*names, "n_near")

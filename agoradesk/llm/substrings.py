"""Substring dedup: Rabin-Karp hashes of every word window, counted over the corpus.

A task hashes all windows of a chunk of documents. A window that occurs twice inside the chunk is settled there; of the others the
hash and the position go to the hash's bucket, where the occurrences of all chunks are counted. Positions found to repeat go back to
their chunk, which merges them into maximal intervals of words. A window of a passage that every document holds is sent once per
chunk, so no bucket grows with the number of copies.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.packing_bytes import pack, unpack
from agoradesk.llm.shared import BATCH_BYTES, boxed, bucket_count, id_and_text, join_by_document, tidy, tidy_groups, write_stage
from agoradesk.llm.words import OTHER_BASE, slices, split_words, window_hashes

#: Windows gathered in a task before they are sent: about 100 bytes of memory each while they are sorted.
CHUNK_WINDOWS = 500_000
INTERVALS = "doc_id long, text_hash long, starts array<int>, ends array<int>"


def repeated_intervals(docs: DataFrame, width: int = 35) -> DataFrame:
    """Word intervals [start, end) covered by windows that occur more than once, per document that has any.

    ``docs`` needs doc_id and text; rows must come in a repeatable order inside their partitions (a stored table does), since a
    lost task names its chunks anew. Rows that are equal in both columns share one result row. Two windows count as equal when 64 bits
    of one hash and the bucket bits of a second one agree.
    """
    if width < 1:
        raise ValueError("width must be 1 or more")
    buckets = bucket_count(docs.sparkSession)
    scan = id_and_text(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.spark_partition_id().alias("part"))
    sent = scan.mapInArrow(tidy(_sender(width, buckets)), "bucket int, chunk string, payload binary")
    found = sent.groupBy("bucket").applyInArrow(tidy_groups(_count), "chunk string, payload binary")
    return found.groupBy("chunk").applyInArrow(tidy_groups(_merger(width)), INTERVALS)


def _sender(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number, part = _Chunk(width), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["part"][0].as_py() if part is None else part
            for a, z in slices(batch["text"]):
                chunk.add(batch.slice(a, z - a))
                if chunk.size >= CHUNK_WINDOWS:
                    yield chunk.rows(f"{part}-{number}", buckets)
                    chunk, number = _Chunk(width), number + 1
        if chunk.size:
            yield chunk.rows(f"{part}-{number}", buckets)

    return run


class _Chunk:
    def __init__(self, width: int):
        self.width, self.size = width, 0
        self.ids, self.texts, self.counts, self.main, self.other = [], [], [], [], []

    def add(self, batch: pa.RecordBatch) -> None:
        words = split_words(batch["text"])
        counts = np.maximum(words.counts - (self.width - 1), 0)
        has = counts > 0
        if not has.any():
            return
        codes = words.hashes()
        self.ids.append(batch["doc_id"].filter(pa.array(has)))
        self.texts.append(batch["text_hash"].filter(pa.array(has)))
        self.counts.append(counts[has])
        self.main.append(window_hashes(codes, words.first, self.width)[0])
        self.other.append(window_hashes(codes, words.first, self.width, OTHER_BASE)[0] >> np.uint64(32))
        self.size += int(counts.sum())

    def rows(self, name: str, buckets: int) -> pa.RecordBatch:
        main = np.concatenate(self.main)
        bucket = (np.concatenate(self.other) & np.uint64(buckets - 1)).astype(np.int32)
        self.main = self.other = []
        order = np.argsort(main, kind="stable")
        held = main[order]
        same = held[1:] == held[:-1]
        held = bucket[order]
        same &= held[1:] == held[:-1]
        del held
        twice = np.zeros(len(main), dtype=bool)
        twice[order[1:][same]] = True
        later = twice.copy()
        twice[order[:-1][same]] = True
        del order, same
        deal = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[deal], np.arange(buckets + 1))
        keys, payloads = [], []
        for b in range(buckets):
            at = deal[edges[b] : edges[b + 1]]
            once, known = at[~twice[at]], at[twice[at] & ~later[at]]
            if len(once) or len(known):
                keys.append(b)
                payloads.append(b"w" + pack(once, main[once], main[known]))
        keys.append(zlib.crc32(name.encode()) % buckets)
        ids, texts = pa.concat_arrays(self.ids), pa.concat_arrays(self.texts)
        head = pack(
            ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), ids.is_null().to_numpy(zero_copy_only=False),
            texts.to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate(self.counts), np.flatnonzero(twice),
        )
        payloads.append(b"d" + head)
        return pa.record_batch({"bucket": pa.array(keys, pa.int32()), "chunk": [name] * len(keys), "payload": pa.array(payloads, pa.binary())})


def _count(table: pa.Table) -> pa.Table:
    names, payloads, chunks = [], [], []
    for name, data in zip(table["chunk"].to_pylist(), table["payload"].to_pylist(), strict=True):
        if data[:1] == b"d":
            names.append(name)
            payloads.append(data)
        else:
            chunks.append((name, *unpack(data[1:])))
    if chunks:
        hashes = np.concatenate([h for _, _, once, known in chunks for h in (once, known)])
        order = np.argsort(hashes, kind="stable")
        same = hashes[order][1:] == hashes[order][:-1]
        again = np.zeros(len(hashes), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = 0
        for name, where, once, known in chunks:
            hit = where[again[at : at + len(once)]]
            at += len(once) + len(known)
            if len(hit):
                names.append(name)
                payloads.append(b"w" + pack(hit))
    return pa.table({"chunk": pa.array(names, pa.string()), "payload": pa.array(payloads, pa.binary())})


def _merger(width: int):
    def run(table: pa.Table) -> pa.Table:
        head, hits = None, []
        for data in table["payload"].to_pylist():
            if data[:1] == b"d":
                head = unpack(data[1:])
            else:
                hits.append(unpack(data[1:])[0])
        if head is None:
            raise ValueError("the documents changed their order between two runs of a task: store them before this step")
        ids, no_id, texts, counts, twice = head
        where = np.sort(np.concatenate([twice, *hits])).astype(np.int64)
        firsts = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
        doc = np.searchsorted(firsts, where, side="right") - 1
        start = where - firsts[doc]
        opens = np.ones(len(start), dtype=bool)
        opens[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)
        closes = np.append(opens[1:], True)[: len(opens)]
        docs, begins, ends = doc[opens], start[opens], start[closes] + width
        own, first = np.unique(docs, return_index=True)
        offsets = np.append(first, len(docs)).astype(np.int32)
        return pa.table({
            "doc_id": pa.array(ids[own].view(np.int64), mask=no_id[own].astype(bool)),
            "text_hash": pa.array(texts[own].view(np.int64)),
            "starts": pa.ListArray.from_arrays(offsets, pa.array(begins.astype(np.int32))),
            "ends": pa.ListArray.from_arrays(offsets, pa.array(ends.astype(np.int32))),
        })

    return run


def with_intervals(docs: DataFrame, width: int = 35) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with ``starts`` and ``ends``: null where nothing repeats."""
    found = write_stage(repeated_intervals(docs, width), "repeats", BATCH_BYTES)
    found = found.groupBy("doc_id", "text_hash").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    return join_by_document(boxed(docs), found)


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
    """(row, words, removed words, kept words joined by one blank) of each document."""
    starts, ends = batch["starts"].to_pylist(), batch["ends"].to_pylist()
    texts = batch["row"].field("text")
    for a, z in slices(texts):
        words = split_words(texts.slice(a, z - a))
        data = words.data.tobytes()
        for i in range(z - a):
            lo, hi = int(words.first[i]), int(words.first[i + 1])
            s, e = starts[a + i] or [], ends[a + i] or []
            if hi == lo:
                yield a + i, 0, 0, b""
                continue
            kept = b" ".join(data[words.start[lo + p] : words.end[lo + q - 1]] for p, q in zip([0, *e], [*s, hi - lo], strict=True) if q > p)
            yield a + i, hi - lo, sum(e) - sum(s), b" ".join(kept.split())


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, removed, hashlib.sha256(kept).hexdigest()) for _, n, removed, kept in _cut(batch)]
        yield pa.record_batch({
            "doc_id": batch["row"].field("doc_id"), "n_words": pa.array([r[0] for r in rows], pa.int64()),
            "n_removed": pa.array([r[1] for r in rows], pa.int64()), "kept_sha256": pa.array([r[2] for r in rows], pa.string()),
        })


def dedup_digest(docs: DataFrame, width: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of ``docs``; a null or empty text has no words."""
    held = with_intervals(id_and_text(docs), width)
    return held.mapInArrow(tidy(_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_texts(docs: DataFrame, width: int = 35) -> DataFrame:
    """``docs`` with the words of repeated windows cut out of ``text``.

    A text without such windows stays as it is, blanks and line ends included; from the others the kept words are joined by one blank.
    A text that loses all its words is empty. Other columns pass unchanged.
    """
    held = with_intervals(docs, width)
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            had = batch["starts"].is_valid().to_pylist()
            old = batch["row"].field("text").to_pylist()
            new = pa.array([kept.decode() if had[i] else old[i] for i, _, _, kept in _cut(batch)], pa.string())
            yield pa.record_batch([new if n == "text" else batch["row"].field(n) for n in names], names=names)

    return held.mapInArrow(tidy(cut), docs.schema)

"""N-gram Jaccard join: T-occurrence search with DivideSkip over the shingle sets of documents.

1. Equal sets are one class; only the smallest document of a class goes on.
2. Shingles are counted over the corpus in hash buckets. A shingle found in one set only can be in no overlap, so a set of which less
   than the threshold is shared links with nothing and is settled.
3. Two sets that link share one of the rarest ``m - T + 1`` shared shingles of each (m shared ones, T the least overlap). Connected by
   those, the remaining sets fall into families; every link lies inside one.
4. Families are dealt in blocks; for every two blocks one task builds inverted lists and searches each set: the short lists are merged,
   the long ones are probed for the candidates left, sets that reach the required overlap link.
5. A task counts every link of its sets and keeps a forest of them; counts add up over tasks, forests become components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agoradesk.llm.components import components
from agoradesk.llm.packing_bytes import pack, unpack
from agoradesk.llm.shared import BATCH_BYTES, bucket_count, id_and_text, tidy, tidy_groups, tidy_keyed_groups, write_stage
from agoradesk.llm.vectors import join_roots
from agoradesk.llm.words import Words, mix, ramps, slices, split_words, window_hashes

#: Shingles gathered in a task before they are sent.
CHUNK_SHINGLES = 1_000_000
#: Sets in a block of a family; a task holds two blocks.
BLOCK_SETS = 64
#: Entries of a list that are read in the time of one probe; long lists are read whole if that is less work.
PROBE_COST = 8
SETS = "doc_id long, n_shingles long, set_a long, set_b long, least int, shingles array<long>"
LINKS = "doc_id long, set_a long, set_b long, root long, links long"
LOW = np.uint64((1 << 56) - 1)


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside it, and the number per text.

    A text of fewer words than ``size`` has its whole sequence as one shingle; a text without words has none.
    """
    codes = words.hashes(lower=True)
    counts = np.maximum(words.counts - (size - 1), 0)
    value, _ = window_hashes(codes, words.first, size)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.array([_sequence(codes[words.first[i] : words.first[i + 1]]) for i in short], dtype=np.uint64)
        value = np.insert(value, np.cumsum(counts)[short] - counts[short], whole)
        counts[short] = 1
    ends = np.cumsum(counts)
    for a, z in zip(ends - counts, ends, strict=True):
        value[a:z].sort()
    doc = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(counts))


def _sequence(codes: np.ndarray) -> np.uint64:
    return window_hashes(codes, np.array([0, len(codes)]), len(codes))[0][0] ^ np.uint64(len(codes))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that a set of n shingles has at least with any set it links with."""
    return -(-n * percent // 100)


def shared_sets(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: the size and two hashes of its set, and for a set that may link its shared shingles, the rarest first.

    ``shingles`` is null for documents that link with nothing but equal sets, and for all but the smallest document of equal sets in a
    chunk. Rows must come in a repeatable order inside their partitions, as those of a stored table do.
    """
    buckets = bucket_count(docs.sparkSession)
    scan = id_and_text(docs).withColumn("part", F.spark_partition_id())
    sent = scan.mapInArrow(tidy(_sender(size, buckets)), "bucket int, chunk string, payload binary")
    found = sent.groupBy("bucket").applyInArrow(tidy_keyed_groups(_counter(buckets)), "chunk string, payload binary")
    return found.groupBy("chunk").applyInArrow(tidy_groups(_collector(percent)), SETS)


def _sender(size: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, counts, held, number, part = [], [], [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["part"][0].as_py() if part is None else part
            for a, z in slices(batch["text"]):
                value, count = shingle_hashes(split_words(batch["text"].slice(a, z - a)), size)
                ids.append(batch["doc_id"].slice(a, z - a))
                values.append(value)
                counts.append(count)
                held += len(value) + len(count)
                if held >= CHUNK_SHINGLES:
                    yield _rows(f"{part}-{number}", ids, values, counts, buckets)
                    ids, values, counts, held, number = [], [], [], 0, number + 1
        if ids:
            yield _rows(f"{part}-{number}", ids, values, counts, buckets)

    return run


def _rows(name: str, ids: list, values: list, counts: list, buckets: int) -> pa.RecordBatch:
    """A chunk as rows: per bucket its shingles, and one row with what the chunk itself needs later."""
    id_array = pa.concat_arrays(ids)
    no_id = id_array.is_null().to_numpy(zero_copy_only=False)
    key = id_array.fill_null(0).to_numpy(zero_copy_only=False)
    value, count = np.concatenate(values), np.concatenate(counts)
    doc = np.repeat(np.arange(len(count)), count)
    set_a = _sums(mix(value), count)
    set_b = _sums(mix(value ^ np.uint64(0x5851F42D4C957F2D)), count)
    # of equal sets in the chunk the smallest id speaks; one without an id never does
    order = np.lexsort((key, no_id, set_b, set_a, count))
    first = np.ones(len(count), dtype=bool)
    first[1:] = (set_a[order][1:] != set_a[order][:-1]) | (set_b[order][1:] != set_b[order][:-1]) | (count[order][1:] != count[order][:-1])
    speaks = np.zeros(len(count), dtype=bool)
    speaks[order[first]] = True
    speaks &= ~no_id
    mask = speaks[doc]
    value, doc = value[mask], doc[mask]
    sort = np.argsort(value, kind="stable")
    value, doc = value[sort], doc[sort]
    same = value[1:] == value[:-1]
    many = np.zeros(len(value), dtype=bool)
    many[1:] |= same
    many[:-1] |= same
    lead = np.ones(len(value), dtype=bool)
    lead[1:] = ~same
    bits = int(buckets).bit_length() - 1
    edges = np.searchsorted((value >> np.uint64(64 - bits)).astype(np.int64), np.arange(buckets + 1))
    keys, payloads = [], []
    for b in range(buckets):
        at = slice(edges[b], edges[b + 1])
        if at.start == at.stop:
            continue
        v, d, m, f = value[at], doc[at], many[at], lead[at]
        alone = np.flatnonzero(~m)
        alone = alone[np.argsort(d[alone], kind="stable")]
        group = v[m & f]
        size = np.diff(np.append(np.flatnonzero(f[m]), int(m.sum())))
        keys.append(b)
        payloads.append(b"s" + pack(d[alone], v[alone] & LOW, group & LOW, size))
    keys.append(len(count) % buckets)
    payloads.append(b"d" + pack(key.view(np.uint64), no_id, count, set_a, set_b, speaks, value[many], doc[many]))
    return pa.record_batch({"bucket": pa.array(keys, pa.int32()), "chunk": [name] * len(keys), "payload": pa.array(payloads, pa.binary())})


def _sums(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.zeros(len(value) + 1, dtype=np.uint64)
    np.cumsum(value, out=total[1:])
    ends = np.cumsum(count)
    return total[ends] - total[ends - count]


def _counter(buckets: int):
    """Number of sets (speaking documents of all chunks) of each shingle of one bucket; those in two sets go back to their chunks."""
    drop = int(buckets).bit_length() - 1 - 8

    def run(key: tuple, table: pa.Table) -> pa.Table:
        top = key[0].as_py() >> drop
        names, payloads, chunks = [], [], []
        for name, data in zip(table["chunk"].to_pylist(), table["payload"].to_pylist(), strict=True):
            if data[:1] == b"d":
                names.append(name)
                payloads.append(data)
            else:
                chunks.append((name, *unpack(data[1:])))
        if chunks:
            value = np.concatenate([x for c in chunks for x in (c[2], c[3])])
            weight = np.concatenate([x for c in chunks for x in (np.ones(len(c[2]), np.int64), c[4].astype(np.int64))])
            distinct, at = np.unique(value, return_inverse=True)
            sets = np.bincount(at, weights=weight, minlength=len(distinct)).astype(np.int64)[at]
            k = 0
            for name, doc, alone, group, _ in chunks:
                one, many = sets[k : k + len(alone)], sets[k + len(alone) : k + len(alone) + len(group)]
                k += len(alone) + len(group)
                hit = one > 1
                if hit.any() or len(group):
                    names.append(name)
                    payloads.append(b"s" + bytes([top]) + pack(doc[hit], alone[hit], one[hit], group, many))
        return pa.table({"chunk": pa.array(names, pa.string()), "payload": pa.array(payloads, pa.binary())})

    return run


def _collector(percent: int):
    def run(table: pa.Table) -> pa.Table:
        head, parts = None, []
        for data in table["payload"].to_pylist():
            if data[:1] == b"d":
                head = unpack(data[1:])
            else:
                parts.append((np.uint64(data[1]) << np.uint64(56), *unpack(data[2:])))
        if head is None:
            raise ValueError("the documents changed their order between two runs of a task: store them before this step")
        key, no_id, count, set_a, set_b, speaks, value, doc = head
        # shingles of several documents of the chunk: their numbers of sets come by value
        low = np.concatenate([b | g for b, _, _, _, g, _ in parts]) if parts else np.zeros(0, np.uint64)
        sets = np.concatenate([m for *_, m in parts]) if parts else np.zeros(0, np.uint64)
        order = np.argsort(low)
        low, sets = low[order], sets[order]
        mine = np.array([], dtype=np.uint64) if not len(value) else sets[np.searchsorted(low, value)]
        docs = np.concatenate([doc, *(d for _, d, *_ in parts)]).astype(np.int64)
        values = np.concatenate([value, *(b | v for b, _, v, *_ in parts)])
        often = np.concatenate([mine, *(o for _, _, _, o, _, _ in parts)])
        order = np.lexsort((values, often, docs))
        docs, values = docs[order], values[order]
        shared = np.bincount(docs, minlength=len(count))
        least = least_overlap(count.astype(np.int64), percent)
        may = (shared >= least) & speaks.astype(bool) & (count > 0)
        take = may[docs]
        sizes = np.where(may, shared, 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32(), mask=np.append(~may, False)), pa.array(values[take].view(np.int64)))
        return pa.table({
            "doc_id": pa.array(key.view(np.int64), mask=no_id.astype(bool)), "n_shingles": pa.array(count.astype(np.int64)),
            "set_a": pa.array(set_a.view(np.int64)), "set_b": pa.array(set_b.view(np.int64)), "least": pa.array(least.astype(np.int32)),
            "shingles": lists,
        })

    return run


def link_sets(sets: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, set_a, set_b, root, links) per task and set that links there; ``sets`` are as :func:`shared_sets` gives them, with
    ``copies``, the number of documents that have the set. Rows of one id and set count once.

    Every two sets meet in one task, so the sum of ``links`` over a set's rows is the number of documents with another set that it links
    with. ``root`` is the smallest document that the set reaches by links of the task.
    """
    alive = sets.where(F.col("shingles").isNotNull())
    few = F.size("shingles") - F.col("least") + 1
    prefix = alive.select("doc_id", F.explode(F.slice("shingles", F.lit(1), few)).alias("shingle"))
    lowest = prefix.groupBy("shingle").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = prefix.join(lowest, "shingle").where("doc_id <> lowest").select(F.col("doc_id").alias("a"), F.col("lowest").alias("b"))
    family = write_stage(components(near), "families")
    size = family.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    placed = family.join(size, "component").select(
        F.col("node").alias("doc_id"), F.col("component").alias("family"), F.ceil(F.col("members") / BLOCK_SETS).cast("int").alias("blocks"),
    )
    held = alive.join(placed, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "doc_id",
        F.col("n_shingles").alias("n"), "set_a", "set_b", "copies", "shingles",
    )
    return dealt.groupBy("family", "low", "high").applyInArrow(tidy_keyed_groups(_searcher(percent)), LINKS)


def _searcher(percent: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        # rows of one id may have several sets, so sets are named by their place here; those of one id and set may come from several chunks
        table = table.sort_by([("doc_id", "ascending"), ("set_a", "ascending"), ("set_b", "ascending")])
        own = np.stack([table[c].to_numpy() for c in ("doc_id", "set_a", "set_b")])
        table = table.filter(pa.array(np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0))))
        ids, copies = table["doc_id"].to_numpy(), table["copies"].to_numpy()
        a, b, _ = search_links(
            np.arange(len(ids)), table["n"].to_numpy(), table["shingles"].combine_chunks(), table["block"].to_numpy(), percent,
            same=key[1].as_py() == key[2].as_py(),
        )
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        root = join_roots(np.arange(len(ids)), a, b)
        found = table.select(["doc_id", "set_a", "set_b"]).append_column("root", pa.array(ids[root])).append_column("links", pa.array(links))
        return found.filter(pa.array(links > 0))

    return run


def search_links(ids: np.ndarray, sizes: np.ndarray, lists: pa.ListArray, block: np.ndarray, percent: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links (a, b, overlap): T-occurrence search of each set among the sets before it (of the other block, if there are two)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    n = len(ids)
    order = np.lexsort((ids, sizes))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    tokens = lists.values.to_numpy()
    owner = rank[np.repeat(np.arange(n), np.diff(offsets))]
    tokens = tokens[offsets[0] : offsets[-1]]
    _, token = np.unique(tokens, return_inverse=True)
    entry = np.sort(token * n + owner)  # inverted lists one after the other, each ascending by set
    first = np.searchsorted(entry, np.arange(int(token.max(initial=-1)) + 2) * n)
    length = np.diff(first)
    mine = np.argsort(owner, kind="stable")
    start = np.searchsorted(owner[mine], np.arange(n + 1))
    sizes, block, ids = sizes[order], block[order], ids[order]
    member = entry % n
    none = np.zeros(0, dtype=np.int64)
    out: list[tuple] = [(none, none, none)]
    for probe in range(n):
        own = token[mine[start[probe] : start[probe + 1]]]
        own = own[length[own] > 1]
        least = int(least_overlap(sizes[probe : probe + 1], percent)[0])
        if len(own) < least:
            continue
        own = own[np.argsort(length[own], kind="stable")]
        # DivideSkip: so many of the longest lists are left out of the merge that the others must still hold T - L occurrences
        longest = int(length[own[-1]])
        left_out = max(0, min(least - 1, int(least / (0.0085 * np.log2(longest) + 1))))
        short, long = own[: len(own) - left_out], own[len(own) - left_out :]
        spans = length[short]
        seen = np.bincount(member[np.repeat(first[short], spans) + ramps(spans)], minlength=n)
        found = np.flatnonzero(seen)
        seen = seen[found]
        keep = (seen >= least - left_out) & (found < probe) & (sizes[found] * 100 >= sizes[probe] * percent)
        if not same:
            keep &= block[found] != block[probe]
        found, seen = found[keep], seen[keep]
        if not len(found):
            continue
        spans = length[long]
        if int(spans.sum()) <= PROBE_COST * len(long) * len(found):
            seen = seen + np.bincount(member[np.repeat(first[long], spans) + ramps(spans)], minlength=n)[found]
        else:
            wanted = long[:, None] * n + found[None, :]
            at = np.minimum(np.searchsorted(entry, wanted), len(entry) - 1)
            seen = seen + (entry[at] == wanted).sum(axis=0)
        hit = seen * 100 >= (sizes[found] + sizes[probe] - seen) * percent
        out.append((np.full(int(hit.sum()), ids[probe]), ids[found[hit]], seen[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def jaccard_links(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id for every row of ``docs``.

    Documents link when 100 · |A ∩ B| ≥ percent · |A ∪ B| over their distinct ``size``-word shingles (A-Z lower-cased). A document
    without words or text links with nothing; rows that share an id are one node of a component, yet each counts as a document of
    its own in ``n_links``; a row without an id gets the component of equal sets, or null if no document with an id has that set. It is
    nobody's partner, and its ``n_links`` is null.
    """
    sets = write_stage(shared_sets(docs, size, percent), "sets", BATCH_BYTES)
    some = sets.where("n_shingles > 0")
    key = ["n_shingles", "set_a", "set_b"]
    lead = some.groupBy(*key).agg(F.min("doc_id").alias("lead"), F.count("doc_id").alias("copies"))
    speaking = some.where("shingles is not null").join(lead, key).where("doc_id = lead")
    found = write_stage(link_sets(speaking.select("doc_id", *key, "copies", "least", "shingles"), percent), "shingle_links")
    links = found.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    # rows of one id with different sets are one node as well
    several = some.select("doc_id", *key).join(lead, key).where("doc_id <> lead")
    links = links.unionAll(several.select(F.col("doc_id").alias("a"), F.col("lead").alias("b")))
    reached = components(links).withColumnRenamed("node", "lead")
    counted = found.groupBy("set_a", "set_b").agg(F.sum("links").alias("links"))
    classes = lead.join(counted, ["set_a", "set_b"], "left").select(*key, "lead", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = sets.select("doc_id", *key).join(classes, key, "left").withColumn("lead", F.coalesce("lead", "doc_id")).join(reached, "lead", "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0)))
    return named.select("doc_id", "n_shingles", n_links.cast("long").alias("n_links"), F.coalesce("component", "lead").alias("component_id"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of :func:`jaccard_links`."""
    return jaccard_links(docs, size, percent).select("doc_id", "n_shingles", "component_id")

"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch are ragged arrays of symbols. In every round each sequence finds its pair of lowest rank and all sequences
merge theirs at once, until none has a pair left; the surviving symbols are the tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from agoradesk.llm.byte_bpe import byte_characters
from agoradesk.llm.pretokens import pretoken_starts
from agoradesk.llm.shared import id_and_text
from agoradesk.llm.words import distinct_spans, first_places, ramps, slices, text_bytes

NONE = np.iinfo(np.int32).max
#: Counts of pre-tokens that a worker remembers; beyond that it starts anew.
REMEMBERED = 200_000


class Merges:
    """Pair ranks of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
        if not plain or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path}: only plain byte-level BPE is counted")
        self.added = [t["content"] for t in spec["added_tokens"]]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must match literally")
        vocab = model["vocab"]
        self.of_byte = np.array([vocab[c] for c in byte_characters()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.shift = np.int64(max(vocab.values()) + 1).item().bit_length()
        keys = np.array([vocab[a] << self.shift | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)  # by rank
        self.counts: dict[bytes, int] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << self.shift | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of symbols left of each byte range."""
        size = end - start
        out = np.ones(len(start), dtype=np.int32)
        own = np.flatnonzero(size > 1)
        size = size[own]
        symbol = self.of_byte[data[np.repeat(start[own], size) + ramps(size)]]
        first = np.cumsum(size) - size
        rank = np.full(len(symbol), NONE, dtype=np.int32)  # of the pair that begins at each symbol
        inner = np.ones(len(symbol), dtype=bool)
        inner[first + size - 1] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(symbol[at], symbol[at + 1])
        while len(own):
            best = np.minimum.reduceat(rank, first)
            over = best == NONE
            if over.any():
                out[own[over]] = size[over]
                keep = np.repeat(~over, size)
                symbol, rank, own, size, best = symbol[keep], rank[keep], own[~over], size[~over], best[~over]
                first = np.cumsum(size) - size
                if not len(own):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # of overlapping pairs (three and more equal symbols in a row) every other one merges, from the left
            run = np.ones(len(hit), dtype=bool)
            run[1:] = hit[1:] != hit[:-1] + 1
            heads = np.flatnonzero(run)
            hit = hit[(np.arange(len(hit)) - heads[np.cumsum(run) - 1]) % 2 == 0]
            sequence = np.searchsorted(first, hit, side="right") - 1
            symbol[hit] = self.made[rank[hit]]
            gone = np.zeros(len(symbol), dtype=bool)
            gone[hit + 1] = True
            last = first + size - 1
            ends_now = hit + 1 == last[sequence]  # the merged symbol is now the last one
            rank[hit] = -1
            rank[hit[ends_now]] = NONE
            before = hit - 1
            before = before[(hit > first[sequence])]
            before = np.where(gone[before], before - 1, before)
            rank[before] = -1
            stay = ~gone
            symbol, rank = symbol[stay], rank[stay]
            size = size - np.bincount(sequence, minlength=len(size))
            first = np.cumsum(size) - size
            new = np.flatnonzero(rank == -1)
            rank[new] = self.rank(symbol[new], symbol[new + 1])
        return out

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token; equal pre-tokens are merged once."""
        code, values = distinct_spans(data, start, end)
        distinct = values.to_pylist()
        counts = np.array([self.counts.get(x, 0) for x in distinct], dtype=np.int32)
        new = np.flatnonzero(counts == 0)
        if len(new):
            at = first_places(code, len(distinct))[new]
            counts[new] = self.merge(data, start[at], end[at])
            if len(self.counts) + len(new) > REMEMBERED:
                self.counts = {}
            self.counts.update((distinct[k], int(counts[k])) for k in new[:REMEMBERED])
        return counts[code]

    def count_texts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; an added token inside a text is one token, as the library has it by default."""
        data, offsets = text_bytes(texts)
        total = np.zeros(len(texts), dtype=np.int64)
        doc = np.arange(len(texts))
        if self.added and (found := self._added(data, offsets)):
            cut = np.array(found)
            np.add.at(total, np.searchsorted(offsets, cut[:, 0], side="right") - 1, 1)
            keep = np.ones(len(data), dtype=bool)
            for a, z in found:
                keep[a:z] = False
            edges = np.unique(np.concatenate([offsets, cut.ravel()]))
            doc = np.searchsorted(offsets, edges[:-1], side="right") - 1
            moved = np.concatenate([[0], np.cumsum(keep)])
            data, offsets = data[keep], moved[edges]
        start = pretoken_starts(data, offsets)
        if len(start):
            counts = self.count(data, start, np.append(start[1:], len(data)))
            held = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.searchsorted(start, offsets)]
            np.add.at(total, doc, np.diff(held))
        return total

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        whole, pattern = data.tobytes(), re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.added, key=len, reverse=True)))
        if not pattern.search(whole):
            return []
        return [
            (int(a) + m.start(), int(a) + m.end())
            for a, z in zip(offsets[:-1], offsets[1:], strict=True)
            for m in pattern.finditer(whole[a:z])
        ]


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document; a null text counts as empty."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merges(path)
        for batch in batches:
            for a, z in slices(batch["text"]):
                part = batch.slice(a, z - a)
                tokens = own.count_texts(part["text"])
                size = np.diff(text_bytes(part["text"])[1])
                yield pa.record_batch({
                    "doc_id": part["doc_id"], "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit),
                })

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

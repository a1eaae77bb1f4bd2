"""Fill-in-middle transformation: cuts are found by a piecewise-linear learned rank index over character boundaries.

The byte offset of the k-th character boundary of a text is a nearly straight line: its slope is the number of bytes a character takes
there. A batch's boundaries are fitted by segments whose error is bounded; each boundary's residual takes one byte. A cut at a
character is predicted by its segment and made exact by the stored residual, so no character is decoded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agoradesk.llm.shared import id_and_text
from agoradesk.llm.words import slices, text_bytes

MARKERS = ("<P>", "<S>", "<M>")
#: Largest distance of a prediction from its boundary; residuals are stored as signed bytes.
MOST_ERROR = 127
#: Bytes whose boundaries are fitted at once: bounds the memory for a text of any length.
CHUNK_BYTES = 2_000_000
ADDED = ("n", "form", "prefix_chars", "middle_chars", "infill")


class RankIndex:
    """Byte offsets of the character boundaries of UTF-8 bytes by rank; the end of the bytes is the last boundary."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, error: int = MOST_ERROR):
        """``starts``: offsets where texts begin; a segment ends where its text ends."""
        if not 0 <= error <= MOST_ERROR:
            raise ValueError(f"error must be 0 to {MOST_ERROR}")
        self.error = error
        first, base, rise, run, residual, rank = [], [], [], [], [], 0
        for a in range(0, len(data), CHUNK_BYTES):
            offset = np.flatnonzero((data[a : a + CHUNK_BYTES] & 0xC0) != 0x80) + a
            if not len(offset):
                continue
            heads = np.searchsorted(offset, starts[np.searchsorted(starts, a) : np.searchsorted(starts, offset[-1], side="right")])
            cuts, left = self._fit(offset, np.unique(np.append(heads, 0)))
            ends = np.append(cuts[1:], len(offset)) - 1
            first.append(cuts + rank)
            base.append(offset[cuts])
            rise.append(offset[ends] - offset[cuts])
            run.append(np.maximum(ends - cuts, 1))
            residual.append(left)
            rank += len(offset)
        self.first = np.concatenate([*first, [rank]])
        self.base = np.concatenate([*base, [len(data)]])
        self.rise = np.concatenate([*rise, [0]]) if rise else np.zeros(1, np.int64)
        self.run = np.concatenate([*run, [1]]) if run else np.ones(1, np.int64)
        self.residual = np.concatenate([*residual, np.zeros(1, np.int8)]) if residual else np.zeros(1, np.int8)
        self.characters = rank

    def _fit(self, offset: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first ranks of the segments, residuals): segments whose line misses a boundary by too much are halved, all at once."""
        residual = np.zeros(len(offset), dtype=np.int8)
        open_from, open_to = cuts, np.append(cuts[1:], len(offset))
        done = []
        while len(open_from):
            size = open_to - open_from
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            at = np.repeat(open_from, size) + inside
            rise, run = offset[open_to - 1] - offset[open_from], np.maximum(size - 1, 1)
            miss = offset[at] - np.repeat(offset[open_from], size) - inside * np.repeat(rise, size) // np.repeat(run, size)
            worst = np.maximum.reduceat(np.abs(miss), np.cumsum(size) - size)
            good = worst <= self.error
            keep = np.repeat(good, size)
            residual[at[keep]] = miss[keep]
            done.append(open_from[good])
            a, z = open_from[~good], open_to[~good]
            middle = (a + z) // 2
            open_from, open_to = np.concatenate([a, middle]), np.concatenate([middle, z])
        return np.sort(np.concatenate(done)), residual

    def rank_of_start(self, offset: np.ndarray) -> np.ndarray:
        """Rank of the boundaries where texts begin or the bytes end: a segment begins at each of them."""
        return self.first[np.searchsorted(self.base, offset)]

    def predict(self, rank: np.ndarray) -> np.ndarray:
        """The byte offset by the rank's segment alone: at most ``error`` off."""
        own = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[own] + (rank - self.first[own]) * self.rise[own] // self.run[own]

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """The exact byte offset of boundary ``rank``."""
        return self.predict(rank) + self.residual[rank]


def cut_words(doc_id, salt: str) -> tuple[int, int, int, int]:
    """The first four 32-bit words of the SHA-256 of ``salt:doc_id``; a null id is the empty string."""
    found = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(found[k : k + 4], "big") for k in (0, 4, 8, 12))


def check_markers(markers: tuple[str, str, str]) -> None:
    """Markers can be found again only if none begins inside another or across a text's edge."""
    heads = {m[:1] for m in markers}
    if len(set(markers)) < 3 or not all(markers) or any(h in m[1:] for h in heads for m in markers):
        raise ValueError("three different markers are needed, whose first characters occur at their beginning only")


def infill_texts(
    docs: DataFrame, salt: str = "1", plain_percent: int = 10, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and ``infill``, the transformed text.

    A text of n characters is cut in prefix, middle and suffix at two places drawn from a hash of the id. ``plain_percent`` of the texts
    stay as they are, as do empty and null texts and those that hold a marker; of the others ``spm_percent`` get the suffix first. Rows
    that repeat an id are cut by the same draws; columns of the added names are replaced, all others pass unchanged.
    """
    check_markers(markers)
    rest = docs.drop(*ADDED)
    names = rest.columns
    prefix_mark, suffix_mark, middle_mark = (m.encode() for m in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z in slices(batch["text"]):
                part = batch.slice(a, z - a)
                data, offsets = text_bytes(part["text"])
                index = RankIndex(data, offsets[:-1])
                rank = index.rank_of_start(offsets)
                n = np.diff(rank)
                draws = [cut_words(i, salt) for i in part["doc_id"].to_pylist()]
                drawn = np.array(draws, dtype=np.int64).reshape(len(n), 4)
                places = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
                at = index.offset(rank[:-1, None] + places)
                whole, rows = data.tobytes(), []
                for i in range(z - a):
                    text = whole[offsets[i] : offsets[i + 1]]
                    if not text or drawn[i, 2] % 100 >= 100 - plain_percent or any(m in text for m in (prefix_mark, suffix_mark, middle_mark)):
                        rows.append(("plain", None, None, text))
                        continue
                    head, middle, tail = whole[offsets[i] : at[i, 0]], whole[at[i, 0] : at[i, 1]], whole[at[i, 1] : offsets[i + 1]]
                    spm = drawn[i, 3] % 100 < spm_percent
                    parts = (suffix_mark, tail, prefix_mark, head) if spm else (prefix_mark, head, suffix_mark, tail)
                    rows.append(("spm" if spm else "psm", int(places[i, 0]), int(places[i, 1] - places[i, 0]), b"".join((*parts, middle_mark, middle))))
                forms, heads, middles, texts = zip(*rows, strict=True)
                yield pa.record_batch(
                    [
                        *(part[c] for c in names), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(heads, pa.int64()),
                        pa.array(middles, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()),
                    ],
                    names=[*names, *ADDED],
                )

    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, *(T.StructField(c, k) for c, k in zip(ADDED, kinds, strict=True))]))


def restored(form: Column, infill: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that :func:`infill_texts` was given (a null text comes back empty)."""
    head, tail, middle = markers

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.instr(infill, second)
        two = F.instr(infill, middle)
        return (
            F.substring(infill, F.lit(len(first) + 1), one - len(first) - 1),
            F.substring(infill, one + len(second), two - one - len(second)),
            F.substring(infill, two + len(middle), F.length(infill)),
        )

    p, s, m = between(head, tail)
    psm = F.concat(p, m, s)
    s, p, m = between(tail, head)
    return F.when(form == "plain", infill).when(form == "psm", psm).otherwise(F.concat(p, m, s))


def infill_digest(docs: DataFrame, salt: str = "1") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 per row of ``docs``."""
    made = infill_texts(id_and_text(docs), salt).select("doc_id", *ADDED)
    again = restored(F.col("form"), F.col("infill"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("infill").cast("binary"), 256).alias("output_sha256"),
        F.sha2(again.cast("binary"), 256).alias("restored_sha256"),
    )

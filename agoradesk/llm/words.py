"""Words and word windows of whole texts as flat numpy arrays.

A batch of texts is one byte buffer, and words are byte ranges of it. Equal ranges are found by their bytes, never by a hash. Where a word
must be told from those of other batches, each distinct one gets a digest of 64 bits, and windows of words are hashed over these. All
are Rabin-Karp polynomials modulo the prime 2^61 - 1, for which no fixed pair of sequences collides at every base.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME = (1 << 61) - 1
# Bases of the polynomial hashes and multipliers of the 64-bit finaliser.
BASE, OTHER_BASE = 0x1E3779B97F4A7C15, 0x16E8FEB86659FD93
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

#: Bytes of text handled at once; a longer text is one slice of its own.
SLICE_BYTES = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that nearby inputs share no bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


M29, M32, P61 = np.uint64((1 << 29) - 1), np.uint64((1 << 32) - 1), np.uint64(PRIME)
THREE, N29, N32, N61 = np.uint64(3), np.uint64(29), np.uint64(32), np.uint64(61)


def fold_prime(x: np.ndarray) -> np.ndarray:
    """64-bit values modulo 2^61 - 1."""
    x = (x & P61) + (x >> N61)
    x -= (x >= P61) * P61
    return x


def shifted(x: np.ndarray) -> np.ndarray:
    """x · 2^32 modulo the prime, not fully reduced, for x below 2^62."""
    return (x >> N29) + ((x & M29) << N32)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of residues modulo 2^61 - 1, by halves of 32 bits; sums are gathered in place."""
    high, low, b_high, b_low = a >> N32, a & M32, b >> N32, b & M32
    middle = high * b_low
    middle += low * b_high
    low = low * b_low
    high = high * b_high
    high <<= THREE
    high += middle >> N29
    middle &= M29
    middle <<= N32
    high += middle
    high += low >> N61
    low &= P61
    high += low
    return fold_prime(high)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo the prime; the longest array of a base is kept for slices of the usual size."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        held = np.ones(1, dtype=np.uint64)
        while len(held) < n:
            held = np.concatenate([held, times(held, np.uint64(pow(base, len(held), PRIME)))])
        held = held[: max(n, 1)]
        if n <= SLICE_BYTES:
            _POWERS[base] = held
    return held[:n]


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Consecutive (start, stop) ranges of a string array with about ``most`` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, stop
        at = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a string array; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a slice: byte range of each, and where the words of each text begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one entry per text and one more: index of its first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit digest per word, the same wherever the word stands."""
        code, distinct = distinct_spans(lower_ascii(self.data) if lower else self.data, self.start, self.end)
        return digests(distinct)[code]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32))


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(number of each byte range's value, the distinct values in the order of their first range)."""
    found = span_array(data, start, end).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def first_places(code: np.ndarray, n: int) -> np.ndarray:
    """Index of the first occurrence of each of the numbers 0 … n-1."""
    out = np.zeros(n, dtype=np.int64)
    out[code[::-1]] = np.arange(len(code))[::-1]
    return out


def polynomials(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Sum of code · base^position modulo the prime over each range of ``codes`` (all below 2^61), positions counted in the range."""
    term = times(codes, powers(base, len(codes)))
    low, high = np.zeros(len(codes) + 1, dtype=np.uint64), np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(term & M32, out=low[1:])  # halves, so that sums of up to 2^32 terms do not wrap
    np.cumsum(term >> N32, out=high[1:])
    total = fold_prime(low[end] - low[start])
    total += fold_prime(shifted(high[end] - high[start]))
    return times(fold_prime(total), powers(pow(base, -1, PRIME), len(codes) + 1)[start])


def digests(values: pa.LargeBinaryArray) -> np.ndarray:
    """64 bits of each value: two polynomials over its pieces of 7 bytes, modulo the prime at different bases, and the length, mixed."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    size = np.diff(offsets)
    place = ramps(size) % 7
    heads = np.flatnonzero(place == 0)
    shifts = (place * 8).astype(np.uint64)
    pieces = np.add.reduceat(whole.astype(np.uint64) << shifts, heads) if len(heads) else np.zeros(0, np.uint64)
    pieces += np.uint64(1)
    end = np.cumsum(-(-size // 7))
    start = end - -(-size // 7)
    one, other = (polynomials(pieces, start, end, base) for base in (BASE, OTHER_BASE))
    return mix(one + mix(other + size.astype(np.uint64) * MIX_2))


def span_array(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.LargeBinaryArray:
    """Byte ranges as binary values."""
    size = end - start
    whole = len(start) > 0 and start[0] == 0 and end[-1] == len(data) and bool((start[1:] == end[:-1]).all())
    if whole:
        body = data
    elif bool((start[1:] >= end[:-1]).all() and (size > 0).all()):
        edge = np.zeros(len(data) + 1, dtype=np.int8)
        edge[start] += 1
        edge[end] -= 1  # an end that is also a start leaves its byte marked
        body = data[np.cumsum(edge[:-1], dtype=np.int8).view(np.bool_)]
    else:
        body = data[np.repeat(start, size) + ramps(size)]
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])


def split_words(texts: pa.Array) -> Words:
    """Maximal runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return."""
    data, offsets = text_bytes(texts)
    return byte_runs(data, offsets, ~((data == 32) | ((data >= 9) & (data <= 13))))


def byte_runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Maximal runs of the bytes marked ``inside``; a run ends where its text ends."""
    gap = ~inside
    begins = inside.copy()
    begins[1:] &= gap[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]
    ends = inside.copy()
    ends[:-1] &= gap[1:]
    lasts = firsts_to_lasts(offsets)
    ends[lasts] = inside[lasts]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def firsts_to_lasts(offsets: np.ndarray) -> np.ndarray:
    return offsets[1:][np.diff(offsets) > 0] - 1


def window_hashes(codes: np.ndarray, first: np.ndarray, width: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every window of ``width`` consecutive codes inside one text.

    Returns (hash of each window, index of its first code), windows in the order of the texts.
    """
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.arange(n - width + 1)
    value = polynomials(fold_prime(codes), place, place + width, base)
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    at = np.repeat(first[:-1], counts) + ramps(counts)
    return mix(value[at]), at


def ramps(counts: np.ndarray) -> np.ndarray:
    """0 … c-1 for each count c, one after the other."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)

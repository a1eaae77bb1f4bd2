"""Pre-tokens of byte-level BPE for whole batches of text, as byte ranges in numpy arrays.

The ranges are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: a run of letters,
numbers or other signs with the blank before it; of white space before something else, all but the last character; and the listed
contractions where their apostrophe begins a match.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# Characters with the property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(WHITE)] = SPACE
    return table


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, code point) of every character of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.uint32)
    code = lead.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        pick = np.flatnonzero((lead >= low) & (lead < (low | mask) + 1)) if size < 4 else np.flatnonzero(lead >= low)
        if len(pick):
            value = lead[pick] & mask
            for k in range(1, size):
                value = (value << np.uint32(6)) | (data[at[pick] + k] & 0x3F).astype(np.uint32)
            code[pick] = value
    return at, code


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every pre-token; texts lie between ``offsets`` and do not touch each other."""
    at, code = characters(data)
    n = len(at)
    if not n:
        return at
    kind = classes()[code]
    opens = np.zeros(n + 1, dtype=bool)
    opens[np.searchsorted(at, offsets)] = True
    opens = opens[:n]
    change = np.ones(n, dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change |= opens
    starts = change.copy()
    blank = np.zeros(n, dtype=bool)  # the character before, in the same text, is a blank
    blank[1:] = code[:-1] == 32
    blank &= ~opens
    solid = kind != SPACE
    starts[change & solid & blank] = False
    last = np.flatnonzero(change[1:] & ~opens[1:] & solid[1:] & (kind[:-1] == SPACE))
    starts[last] = True  # white space right before something else
    quote = np.flatnonzero((code == 39) & change & ~blank)
    quote = quote[quote + 1 < n]
    quote = quote[~opens[quote + 1]]
    one = code[quote + 1]
    second = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~opens[second], code[second], 0)
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    single = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    for found, size in ((quote[single], 2), (quote[pair], 3)):
        starts[found + 1] = False
        after = found + size
        after = after[after < n]
        starts[after[(kind[after] == LETTER) & ~opens[after]]] = True
    return at[starts]

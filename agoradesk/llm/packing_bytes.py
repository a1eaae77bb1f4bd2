"""Integer arrays as compact bytes, for rows that carry many small numbers through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned integers below 2^64; ascending arrays become differences, zero high bytes vanish."""
    parts = [len(arrays).to_bytes(1, "little")]
    for values in arrays:
        values = np.ascontiguousarray(values, dtype=np.uint64)
        rising = len(values) > 1 and bool(np.all(values[1:] >= values[:-1]))
        if rising:
            values = np.diff(values, prepend=np.uint64(0))
        top = int(values.max()) if len(values) else 0
        width = max(1, (top.bit_length() + 7) // 8)
        planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
        body = b""
        for plane in planes:
            raw = plane.tobytes()
            small = zstandard.compress(raw, 1) if len(raw) > 16 else raw
            keep = len(small) < len(raw)
            body += (len(small) * 2 + 1 if keep else len(raw) * 2).to_bytes(5, "little") + (small if keep else raw)
        parts.append(len(values).to_bytes(5, "little") + bytes([width * 2 + rising]) + body)
    return b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        n, flags = int.from_bytes(data[at : at + 5], "little"), data[at + 5]
        at += 6
        width, rising = flags >> 1, flags & 1
        grid = np.zeros((n, 8), dtype=np.uint8)
        for k in range(width):
            head = int.from_bytes(data[at : at + 5], "little")
            raw = data[at + 5 : at + 5 + (head >> 1)]
            at += 5 + (head >> 1)
            grid[:, k] = np.frombuffer(zstandard.decompress(raw, max_output_size=n) if head & 1 else raw, dtype=np.uint8)
        values = grid.view(np.uint64).reshape(-1)
        out.append(np.cumsum(values, dtype=np.uint64) if rising else values)
    return out

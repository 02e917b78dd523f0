"""Smooth series of doubles as few bytes, exactly.

The bits of neighbouring doubles, read as whole numbers, differ little where a series is smooth, their differences differ
less, and so on. Differences of the seventh order are kept, signs folded in, byte planes compressed: every bit pattern
comes back, NaN and signed zeros too, since differences and sums of 64-bit numbers wrap around.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Decaying series lose about six bits an order, and rounding adds one: seven is where both meet.
ORDER = 7


def packed(values: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The first ``sizes[i]`` numbers of each row of a table of doubles."""
    codec, v = pa.Codec("zstd", compression_level=3), np.ascontiguousarray(values, dtype=np.float64).view(np.int64)
    for _ in range(ORDER):
        v = np.diff(v, axis=1, prepend=0)
    planes = ((v << 1) ^ (v >> 63)).view(np.uint8).reshape(*v.shape, 8).transpose(0, 2, 1)
    return [codec.compress(p[:, :n].tobytes(), asbytes=True) for p, n in zip(planes, sizes.tolist(), strict=True)]


def unpacked(parts: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """The numbers of all parts, one after another."""
    codec = pa.Codec("zstd")
    planes = np.zeros((len(parts), 8, int(sizes.max(initial=0))), np.uint8)
    for row, part, n in zip(planes, parts, sizes.tolist(), strict=True):
        row[:, :n] = np.frombuffer(codec.decompress(part, n * 8), np.uint8).reshape(8, n)
    u = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(np.uint64)[..., 0]
    v = ((u >> np.uint64(1)) ^ (np.uint64(0) - (u & np.uint64(1)))).view(np.int64)
    for _ in range(ORDER):
        v = np.cumsum(v, axis=1)
    return v.view(np.float64)[np.arange(v.shape[1]) < sizes[:, None]]

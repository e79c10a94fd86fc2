"""Words of many texts at once, as arrays: where they lie and 64-bit hashes of them."""

from __future__ import annotations

import hashlib

import numpy as np

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_LONG = 2048


def word_hashes(buf: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, over 8 bytes at a time; ``buf`` has 8 bytes to spare."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    keep = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    h = length.astype(np.uint64) * _MIX[2]
    long = np.flatnonzero(length > _LONG)
    live = np.flatnonzero(length <= _LONG)
    at = 0
    while len(live):
        left = np.minimum(length[live] - at, 8)
        x = (h[live] ^ (words[start[live] + at] & keep[left])) * _MIX[0]
        x = (x ^ (x >> np.uint64(29))) * _MIX[1]
        h[live] = x ^ (x >> np.uint64(32))
        at += 8
        live = live[length[live] > at]
    for i in long.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : start[i] + length[i]], digest_size=8).digest(), "little")
    return h


def word_edges(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end, of a flag for each byte that separates them."""
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    return edge[::2], edge[1::2]

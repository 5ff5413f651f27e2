"""Vectorised word positions and hashes of many texts at once."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _MUL)
#: White space of the word definition: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@dataclass
class Words:
    """Words of several texts: byte ranges in ``data``, hashes, and the texts' first words (one more entry than texts)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    text_at: np.ndarray


def words_of(texts: list[bytes]) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the texts. Hashes are polynomial over the bytes, mod 2**64, then mixed with the length."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    text_at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)))
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(16, (len(data) + 1).bit_length()))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    value = (sums[end] - sums[start]) * down[start]
    first = np.searchsorted(start, text_at)
    return Words(data, start, end, mix64(value + (end - start).astype(np.uint64) * _MUL), first, text_at)


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive hashes of all windows of ``n`` words; windows over the border of two texts are the caller's to leave out."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for i in range(1, n):
        out = out * np.uint64(_BASE) + hashes[i : i + len(out)]
    return mix64(out)

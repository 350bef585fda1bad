"""White-space words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = 2**64 - 1
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        _POW = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, dtype=np.uint64)])
        _INV = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(_BASE, -1, 2**64), dtype=np.uint64)])
    return _POW[:n], _INV[:n]


def split_hashed(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, begin, end, 64-bit hash, text index) of each word, in order."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.r_[0, edge]
    begin, end = edge[0::2], edge[1::2]
    power, inverse = _powers(len(buf))
    total = np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power)
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    hashed = mix((total[end - 1] - before) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    limits = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    return joined, begin, end, hashed, np.searchsorted(limits, begin, side="right")


def batches(texts: list[bytes], most: int = 1_000_000):
    """Runs of texts of about so many bytes; a longer text stands alone."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to

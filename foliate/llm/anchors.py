"""Anchors: places in a text chosen by content, so that equal strings of `length` bytes have equal anchors at equal distances."""

from __future__ import annotations

import numpy as np

GRAM, BLOCK, SEED = 32, 1 << 22, 990_011
_WORDS = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)
_PLACE = np.uint64((1 << 23) - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place on."""
    h = _WORDS[data]
    k = 1
    while k < GRAM:  # each step doubles the bytes that a hash covers
        h = h[:-k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) + h[k:]
        k *= 2
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    return h


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, hash, low, high: of each anchor; the strings of `length` bytes that start from low to high (inclusive) are its own, and each string is one anchor's."""
    n, out = len(data), []
    for at in range(0, max(0, n - length + 1), BLOCK):
        part = data[at : at + BLOCK + length - 1]
        h = gram_hashes(part)
        m = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # the least hash, of equal ones the first
        span, k = length - GRAM + 1, 1
        while 2 * k <= span:
            m = np.minimum(m[:-k], m[k:])
            k *= 2
        if k < span:
            m = np.minimum(m[: len(m) - (span - k)], m[span - k :])
        place = (m & _PLACE).astype(np.int64)
        low = np.flatnonzero(np.diff(place, prepend=-1))
        high = np.append(low[1:], len(place)) - 1
        out.append((place[low] + at, h[place[low]], low + at, high + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))

"""Word shingles as 64-bit hashes, in numpy, a text at a time."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RANDOM.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(255, _BASE)]), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, fold: bool = True) -> np.ndarray:
    """A hash for each maximal run of bytes that are not ASCII white space, A-Z taken as a-z unless ``fold`` is off."""
    global _POWERS
    raw = np.frombuffer(data, np.uint8)
    raw = _LOWER[raw] if fold else raw
    solid = ~_WHITE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64)
    starts = np.flatnonzero(first[at])
    lengths = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    if (longest := int(lengths.max())) > len(_POWERS):
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, _BASE)]), dtype=np.uint64)
    return mixed(np.add.reduceat(_BYTE[raw[at]] * _POWERS[place], starts) + lengths.astype(np.uint64))


def shingle_set(data: bytes, n: int) -> np.ndarray:
    """The sorted distinct n-word shingles; with fewer words the whole sequence as one, without words none."""
    words = word_hashes(data)
    if not len(words):
        return words
    size = min(n, len(words))
    total = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        total += words[k : len(words) - size + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))

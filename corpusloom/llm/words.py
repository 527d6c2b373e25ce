"""Words of texts as 64-bit hashes, with numpy over whole blocks."""

from __future__ import annotations

import numpy as np

_SPACES = np.zeros(256, bool)
_SPACES[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _multipliers(count: int) -> np.ndarray:
    return mix((np.arange(1, count + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of non-space bytes, and the text that has it; none crosses two texts."""
    spaced = np.concatenate([_SPACES[data], [True]])
    ends_here = np.zeros(len(data) + 1, bool)
    ends_here[offsets] = True
    starts = np.flatnonzero(~spaced[:-1] & np.concatenate([[True], spaced[:-2] | ends_here[1:-1]])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(~spaced[:-1] & (spaced[1:] | ends_here[1:])) + 1 if len(data) else starts
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
    values = data[np.repeat(starts, sizes) + place]
    if lower:
        values = _LOWER[values]
    weights = _multipliers(int(sizes.max()))
    sums = np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * weights[place], begins)
    return mix(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring hashes."""
    count = max(0, len(hashes) - size + 1)
    total = np.zeros(count, np.uint64)
    for k, weight in enumerate(_multipliers(size)):
        total += hashes[k : k + count] * weight
    return mix(total)

"""Suffix arrays by induced sorting and their permuted common prefixes, with numpy.

The array is scanned in runs instead of single entries: while all slots up to some place are filled,
their suffixes induce others in one vectorised step; the next run ends at the first slot still empty.
"""

from __future__ import annotations

import numpy as np


def _suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where it is larger (L)."""
    n = len(text)
    changes = np.flatnonzero(text[1:] != text[:-1])
    rises = text[changes + 1] > text[changes]
    smaller = np.ones(n, bool)
    if len(changes):
        at = np.searchsorted(changes, np.arange(n - 1))
        smaller[:-1] = rises[np.minimum(at, len(changes) - 1)]
    return smaller


def _order_in_groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by key, each place's number within its key, and where keys start and how often they occur."""
    order = keys.argsort(kind="stable")
    ranked = keys[order]
    new = np.empty(len(ranked), bool)
    new[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    starts = new.nonzero()[0]
    sizes = np.empty(len(starts), np.int64)
    np.subtract(starts[1:], starts[:-1], out=sizes[:-1])
    sizes[-1:] = len(ranked) - starts[-1:]
    return order, np.arange(len(ranked)) - starts.repeat(sizes), starts, sizes


def _induce(text: np.ndarray, seeds: np.ndarray, seed_heads: np.ndarray, heads: np.ndarray, size: int, take: np.ndarray):
    """Fill an array in which ``seeds`` already have their slots, from left to right.

    An entry e induces e-1 if ``take`` holds there: it goes to the next free slot of its symbol.
    """
    slots = np.full(size + 1, -1, np.int32)
    slots[seed_heads] = seeds
    slots[size] = -2  # ends the last run
    at = 0
    while at < size:
        end = at
        step = 64
        while True:  # the first empty slot
            empty = slots[end : end + step] < 0
            hit = int(empty.argmax())
            if empty[hit]:
                end += hit
                break
            end += step
            step *= 2
        run = slots[at:end] - 1
        run = run[run >= 0]
        run = run[take[run]]
        if len(run) < 8:
            for suffix, symbol in zip(run.tolist(), text[run].tolist()):
                slots[heads[symbol]] = suffix
                heads[symbol] += 1
        else:
            symbols = text[run]
            order, number, starts, sizes = _order_in_groups(symbols)
            symbols = symbols[order]
            slots[heads[symbols] + number] = run[order]
            heads[symbols[starts]] += sizes
        at = end
    return slots[:size]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of whole numbers from 0 on; the last one must be 0 and the only 0."""
    text = np.ascontiguousarray(text, np.int32)
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    symbols = int(text.max()) + 1
    small = _suffix_types(text)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    counts = np.bincount(text, minlength=symbols)
    large_counts = np.bincount(text[~small], minlength=symbols)
    small_counts = counts - large_counts
    seed_counts = np.bincount(text[leftmost], minlength=symbols)

    def sorted_suffixes(seeds: np.ndarray) -> np.ndarray:
        """All suffixes, induced from leftmost-smaller ones in the given order."""
        order, number, _, _ = _order_in_groups(text[seeds])
        placed = seeds[order]
        starts = np.cumsum(large_counts + seed_counts) - large_counts - seed_counts
        where = starts[text[placed]] + large_counts[text[placed]] + number
        found = _induce(text, placed, where, starts.copy(), len(seeds) + n - int(small.sum()), ~small)
        large = found[~small[found]]
        # from right to left: the same scan on mirrored slots
        starts = np.cumsum((large_counts + small_counts)[::-1])[::-1] - large_counts - small_counts
        ends = starts + small_counts  # mirrored: a symbol's smaller suffixes come first
        mirrored = large[::-1]
        order, number, _, _ = _order_in_groups(text[mirrored])
        mirrored = mirrored[order]
        where = np.r_[ends[text[mirrored]] + number, starts[0]]
        found = _induce(text, np.r_[mirrored, n - 1], where, starts.copy(), n, small)
        return found[::-1]

    if len(leftmost) > 1:
        found = sorted_suffixes(leftmost)
        is_leftmost = np.zeros(n, bool)
        is_leftmost[leftmost] = True
        ranked = found[is_leftmost[found]]
        length = np.ones(n, np.int64)
        length[leftmost[:-1]] = np.diff(leftmost) + 1
        a, b = ranked[:-1], ranked[1:]
        same = length[a] == length[b]
        pairs = np.flatnonzero(same)
        sizes = length[a[pairs]]
        if len(pairs):
            begins = np.cumsum(sizes) - sizes
            inside = np.arange(int(sizes.sum())) - np.repeat(begins, sizes)
            equal = text[np.repeat(a[pairs], sizes) + inside] == text[np.repeat(b[pairs], sizes) + inside]
            same[pairs] = np.logical_and.reduceat(equal, begins)
        names = np.r_[0, np.cumsum(~same)]
        if names[-1] + 1 < len(ranked):
            name_of = np.zeros(n, np.int32)
            name_of[ranked] = names
            ranked = leftmost[suffix_array(name_of[leftmost])]
    else:
        ranked = leftmost
    return sorted_suffixes(ranked)


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix, how many symbols it shares with the suffix before it in the array.

    Compared symbol by symbol only where the symbols before both differ; elsewhere the value is one less
    than that of the suffix one to the left.
    """
    n = len(text)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    reducible = np.zeros(n, bool)
    reducible[1:] = (before[1:] > 0) & (text[:-1] == text[np.maximum(before[1:] - 1, 0)])
    starts = np.flatnonzero(~reducible)
    values = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(before[starts] >= 0)
    a, b = starts[live], before[starts[live]]
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.full(8, -1, text.dtype)]), 8)
    ends = np.ones((len(live), 1), bool)
    while len(live):
        left = windows[a]
        differs = (left != windows[b]) | (left < 0)
        most = np.concatenate([differs, ends[: len(live)]], axis=1).argmax(axis=1)
        values[live] += most
        go = most == 8
        live, a, b = live[go], a[go] + 8, b[go] + 8
    sizes = np.diff(starts, append=n)
    return np.repeat(values + starts, sizes) - np.arange(n)

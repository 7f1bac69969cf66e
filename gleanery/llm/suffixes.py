"""Suffix arrays over symbol ids, and searches for many queries at once. Id 0 matches nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def known_run(ids: np.ndarray) -> np.ndarray:
    """For each position, how many symbols up to the next unknown one (id 0)."""
    stops = np.flatnonzero(ids == 0).astype(np.int32)
    return np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(len(ids), dtype=np.int32)


def packed_keys(ids: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """For each position, and `depth` beyond the end, as many symbols from there on as fit in 63 bits."""
    per_key = 63 // bits
    padded = np.concatenate([ids, np.zeros(depth + per_key, dtype=ids.dtype)])
    keys = np.zeros(len(ids) + depth, dtype=np.int64)
    for j in range(per_key):
        keys <<= bits
        keys |= padded[j : j + len(keys)]
    return keys


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """starts in the lexicographic order of the `depth` symbols that follow each."""
    bits = max(1, int(ids.max(initial=1)).bit_length())
    return sort_suffixes(packed_keys(ids, depth, bits), starts, depth, 63 // bits)


def sort_suffixes(keys: np.ndarray, starts: np.ndarray, depth: int, per_key: int) -> np.ndarray:
    """starts in the order of their keys, then of the keys `per_key` places further on, and so on.

    Later keys are only compared among suffixes that are equal so far.
    """
    order = starts[np.argsort(keys[starts], kind="stable")]
    first = keys[order]
    group = np.concatenate([[0], np.cumsum(first[1:] != first[:-1])]) if len(order) else np.zeros(0, dtype=np.int64)
    for shift in range(per_key, depth, per_key):
        tied = np.zeros(len(order), dtype=bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        if not len(at):
            break
        key = keys[order[at] + shift]
        by = np.lexsort((key, group[at]))
        order[at], key, old = order[at][by], key[by], group[at]
        fresh = np.concatenate([[False], (old[1:] != old[:-1]) | (key[1:] != key[:-1])])
        steps = np.zeros(len(order), dtype=np.int64)
        steps[1:] = group[1:] != group[:-1]
        steps[at] |= fresh
        group = np.cumsum(steps)
    return order


class Patterns:
    """Fixed strings of symbols to look for in many suffix arrays, packed like these."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int):
        self.lengths, self.per_key, self.longest = lengths, 63 // bits, int(lengths.max(initial=1))
        self.low, self.high = [], []
        for at in range(0, self.longest, self.per_key):
            low = np.zeros(len(starts), dtype=np.int64)
            high = np.zeros(len(starts), dtype=np.int64)
            for j in range(at, at + self.per_key):
                there = j < lengths
                symbol = np.where(there, words[np.minimum(starts + j, len(words) - 1)] if len(words) else 0, 0)
                low, high = low << bits | symbol, high << bits | np.where(there, symbol, (1 << bits) - 1)
            self.low.append(low)
            self.high.append(high)

    def search(self, keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high) of the patterns that occur: binary search of all at once, a key deeper at a time."""
        first, found = keys[order], []
        low, high = np.searchsorted(first, self.low[0], "left"), np.searchsorted(first, self.high[0], "right")
        pattern = np.flatnonzero(low < high)
        low, high = low[pattern], high[pattern]
        for depth in range(1, len(self.low) + 1):
            ends = self.lengths[pattern] <= depth * self.per_key
            found.append((pattern[ends], low[ends], high[ends]))
            pattern, low, high = pattern[~ends], low[~ends], high[~ends]
            if not len(pattern):
                break
            column = lambda at, d=depth: keys[order[at] + d * self.per_key]
            low, high = bound(column, self.low[depth][pattern], low, high, False), bound(column, self.high[depth][pattern], low, high, True)
            pattern, low, high = (x[low < high] for x in (pattern, low, high))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def search(ids: np.ndarray, array: np.ndarray, queries) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """Binary-search all queries at once, a symbol deeper at a time.

    queries has words (symbols of all, one after another), starts (where each
    begins), left (for each symbol, how many its query has from there on) and
    longest. ids must be padded by as many zeros.

    Yields (depth, queries, low, high, (from, to)): the suffixes array[low:high]
    share their first `depth` symbols with the query, array[from:to] one more;
    from = to = high if none does. Queries end where nothing matches.
    """
    query = np.arange(len(queries.starts))
    low, high = np.zeros(len(query), dtype=np.int64), np.full(len(query), len(array), dtype=np.int64)
    for depth in range(queries.longest + 1):
        more = np.flatnonzero(queries.left[queries.starts[query]] > depth)
        wanted = queries.words[queries.starts[query[more]] + depth]
        column = lambda at, d=depth: ids[array[at] + d]
        below = high.copy(), high.copy()
        below[0][more] = bound(column, wanted, low[more], high[more], False)
        below[1][more] = bound(column, wanted, low[more], high[more], True)
        none = below[0] >= below[1]
        below[0][none], below[1][none] = high[none], high[none]
        if depth:
            yield depth, query, low, high, below
        query, low, high = query[~none], below[0][~none], below[1][~none]
        if not len(query):
            return


def bound(column, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, upper: bool) -> np.ndarray:
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) >> 1
        seen = column(mid)
        right = seen <= wanted[open_] if upper else seen < wanted[open_]
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all ranges in turn, and the number of the range of each."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + low[which], which

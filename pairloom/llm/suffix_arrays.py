"""Suffix arrays of fixed-length word rows: Larsson-Sadakane refinement, Kasai's common prefixes,
and merging by binary search, in numpy."""

from __future__ import annotations

import numpy as np


def refine(words: np.ndarray) -> np.ndarray:
    """Rank of every suffix of every row of ``words`` (rows by words), flat. The rank of a suffix is
    the place in the suffix array where the suffixes equal to it begin. Prefix doubling in the manner
    of Larsson and Sadakane: groups that are already single are never sorted again. A suffix ends with
    its row, and an ended suffix comes before all others."""
    rows, width = words.shape
    _, rank = np.unique(words.ravel(), return_inverse=True)
    size = np.bincount(rank)
    rank = (np.cumsum(size) - size)[rank]
    column = np.tile(np.arange(width), rows)
    h = 1
    while h < width:
        size = np.bincount(rank, minlength=len(rank))
        at = np.flatnonzero(size[rank] > 1)
        if not len(at):
            break
        inside = column[at] + h < width
        after = np.where(inside, rank[np.where(inside, at + h, 0)] + 1, 0)
        key = rank[at] * np.int64(len(rank) + 1) + after
        order = np.argsort(key, kind="stable")
        at, key, group = at[order], key[order], rank[at[order]]
        place = np.arange(len(at))
        group_start = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), place, 0))
        key_start = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), place, 0))
        rank[at] = group + key_start - group_start
        h *= 2
    return rank


def kasai(words: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix of each suffix in it with the one before, in words). Kasai's walk
    goes through the places of a row from left to right, and loses at most one word in a step; here
    all rows walk at once."""
    rows, width = words.shape
    flat = words.ravel()
    array = np.argsort(rank, kind="stable")
    place = np.empty(len(array), np.int64)
    place[array] = np.arange(len(array))
    common = np.zeros(len(array), np.int64)
    h = np.zeros(rows, np.int64)
    start = np.arange(rows) * width
    for j in range(width):
        at = start + j
        spot = place[at]
        before = array[np.maximum(spot - 1, 0)]
        room = np.minimum(width - j, width - before % width)
        h = np.where(spot > 0, np.minimum(np.maximum(h - 1, 0), room), 0)
        going = np.flatnonzero((spot > 0) & (h < room))
        while len(going):
            same = flat[at[going] + h[going]] == flat[before[going] + h[going]]
            going = going[same]
            h[going] += 1
            going = going[h[going] < room[going]]
        common[spot] = h
    return array, common


def order_rows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order, words that each has in common with the one before) from the suffix array."""
    rows, width = words.shape
    array, common = kasai(words, refine(words))
    where = np.flatnonzero(array % width == 0)
    least = common.copy()
    # from one row to the next the common prefix is the least of those in between
    cut = np.concatenate(([0], where[:-1] + 1))
    between = np.minimum.reduceat(np.append(least, 0), np.stack([cut, where + 1], 1).ravel())[::2] if len(where) else where
    between[:1] = 0
    return array[where] // width, between


def byte_prefix(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of ``strings`` (rows by bytes) has in common with the one before it."""
    if not len(order):
        return np.zeros(0, np.int64)
    differ = strings[order[1:]] != strings[order[:-1]]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return np.concatenate(([0], first))


def as_words(strings: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Rows of big-endian 8-byte words behind a leading word, so that words order as bytes do."""
    return np.concatenate([lead[:, None].view(np.uint64), np.ascontiguousarray(strings).view(">u8").astype(np.uint64)], axis=1)


def merge_orders(strings: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One order from the orders of two shards: each row of the second is searched for in the first."""
    keys = np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").ravel()
    spots = np.searchsorted(keys[first], keys[second], side="right")
    return np.insert(first, spots, second)

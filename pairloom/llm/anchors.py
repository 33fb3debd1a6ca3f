"""Content-defined anchors: places that two occurrences of one long string have in common."""

from __future__ import annotations

import numpy as np

from pairloom.llm.shingles import mix

WIDTH = 32  # bytes of an anchor; a power of two
BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every run of ``WIDTH`` bytes."""
    h, power, width = codes.astype(np.uint64) + np.uint64(1), BASE, 1
    with np.errstate(over="ignore"):
        while width < WIDTH:
            h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
            power, width = power * power, 2 * width
    return mix(h)


def leftmost_minima(h: np.ndarray, span: int) -> np.ndarray:
    """Ordered places of the leftmost minimum of every ``span`` consecutive values. Which place it is
    depends on the values in its window alone, so equal strings choose alike."""
    if len(h) < span:
        return np.zeros(0, np.int64)
    n = len(h) - span + 1
    blocks = -(-len(h) // span)
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(h)] = h
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n])
    # places that equal the minimum of a window they are in; where equal values repeat, the leftmost of each window
    place = np.flatnonzero(h == _widest(least, len(h), span))
    return _leftmost(place, h, least, span)


def _widest(least: np.ndarray, n: int, span: int) -> np.ndarray:
    """For each place the greatest of the minima of the windows that hold it."""
    padded = np.zeros(n + span - 1 + (-(n + span - 1)) % span, np.uint64)
    padded[span - 1 : span - 1 + len(least)] = least
    grid = padded.reshape(-1, span)
    ahead = np.maximum.accumulate(grid, axis=1).ravel()
    behind = np.maximum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(behind[:n], ahead[span - 1 : span - 1 + n])


def _leftmost(place: np.ndarray, h: np.ndarray, least: np.ndarray, span: int) -> np.ndarray:
    """Of the candidates, those that are the leftmost minimum of some window: the window that begins
    just behind the previous equal candidate (or ``span - 1`` before this one) must have this minimum."""
    if not len(place):
        return place
    value = h[place]
    order = np.lexsort((place, value))
    before = np.full(len(place), -1, np.int64)
    same = value[order][1:] == value[order][:-1]
    before[order[1:][same]] = place[order[:-1][same]]
    first = np.maximum(np.maximum(before + 1, place - span + 1), 0)
    last = np.minimum(place, len(least) - 1)
    # minima of windows first..last: the value is the greatest of them if any equals it
    good = np.zeros(len(place), bool)
    simple = first <= last
    # a window in the range has this minimum iff the greatest minimum over the range is the value
    for i in np.flatnonzero(simple & (before >= place - span + 1) & (before >= 0)):
        good[i] = bool((least[first[i] : last[i] + 1] == value[i]).any())
    good[simple & ~((before >= place - span + 1) & (before >= 0))] = True
    return place[good]

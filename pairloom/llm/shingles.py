"""Word shingles of whole texts as sets of 64-bit hashes, computed by the chunk in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 20
B = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
B_INVERSE = pow(B, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)


def words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end and hash of each word). Words are runs outside \\x20 and \\x09-\\x0D."""
    codes = np.frombuffer(data, np.uint8)
    inside = np.concatenate(([False], ~SPACE[codes], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(B, len(codes)), dtype=np.uint64)))
        return start, end, mix((total[end] - total[start]) * _power(B_INVERSE, len(codes))[start] ^ (end - start).astype(np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, hash of each word)."""
    start, _, h = words_of(data)
    return start, h


def combine(words: np.ndarray) -> np.uint64 | np.ndarray:
    """The hash of consecutive words, along the first axis."""
    with np.errstate(over="ignore"):
        h = np.full(words.shape[1:], len(words), np.uint64)
        for w in words:
            h = mix(h * np.uint64(B) + w)
        return h


def _distinct(h: np.ndarray) -> np.ndarray:
    h = h.view(np.int64).copy()
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_sets(texts: Iterable[str | bytes | None], size: int) -> Iterator[np.ndarray]:
    """For each text, in order, its distinct shingles as a sorted array of longs. A-Z are
    lower-cased. A text of fewer words is one shingle, one without words has none."""
    group: list[bytes] = []
    total = 0
    for text in texts:
        group.append((text if isinstance(text, bytes) else (text or "").encode()).lower())
        total += len(group[-1]) + 1
        if total >= CHUNK:
            yield from _group_sets(group, size)
            group, total = [], 0
    if group:
        yield from _group_sets(group, size)


def _group_sets(group: list[bytes], size: int) -> Iterator[np.ndarray]:
    start, words = word_hashes(b"\n".join(group))
    n = len(words)
    every = combine(np.stack([words[i : n - size + 1 + i] for i in range(size)])) if n >= size else np.zeros(0, np.uint64)
    ends = np.searchsorted(start, np.cumsum([len(g) + 1 for g in group]))
    low = 0
    for high in ends:
        if high - low >= size:
            yield _distinct(every[low : high - size + 1])
        elif high > low:
            yield combine(words[low:high, None]).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
        low = high

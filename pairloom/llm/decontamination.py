"""Benchmark decontamination by q-gram filtering and banded alignment.

Benchmark items are cut into overlapping segments of ``SEGMENT`` characters and
into parts of ``PART`` characters every ``PART_STRIDE``, so that a leaked part of
an item is found as well, whatever its offset: any verbatim part of
``PART + PART_STRIDE - 1`` (74) characters holds a whole part. Parts of an item that
fits one segment count only verbatim: it is edited beyond ERRORS as a whole
otherwise. A place of a document holds a segment or part of m characters if an
alignment of at most k = ERRORS * m edits exists. By the q-gram
lemma such a place shares at least m + 1 - q * (k + 1) q-grams with the segment,
and their diagonals (place in the text minus place in the segment) lie within k
of each other. Shared q-grams are therefore counted in overlapping bands of
2 * (k + 1) diagonals; only bands that reach the bound are aligned, by dynamic
programming inside the band.

Items of fewer than ``MIN_ITEM`` characters would match everyday phrases with an
edit or two; they are sought verbatim, between word boundaries.

Both sides are folded first: lower-cased, a run of white space (as Unicode has it,
and control characters) is one blank, and of a run of more than ``RUN`` equal
characters ``RUN`` count. Shared q-grams are counted in lots of bounded size, from
left to right, so memory does not grow with how often a text repeats what an item
repeats.

The benchmark is the stated query set: it is broadcast in blocks of at most
``BLOCK_CHARS`` characters. With more than one block a bitmap of all their q-grams
(16 MB) first picks the documents that may hold anything, in one pass; only those
are held against each block, and a block's broadcast goes before the next comes.

Defined results: null or empty texts hold nothing; items that are null or hold
nothing but white space are not searched for; equal items are searched for once
each; without items there are no rows. Every row of the documents is judged by
itself, copies included; other columns are ignored. Texts of any length are
searched as a whole.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import fresh, map_batches, row_key
from pairloom.session import settle

Q = 8
ERRORS = 0.08
SEGMENT, STRIDE = 120, 60
PART, PART_STRIDE = 60, 15
MIN_ITEM = 32
RUN = 3
BLOCK_CHARS = 1 << 20
SLICE = 1 << 20
LOT = 1 << 21  # shared q-grams that are counted at a time
TABLE_BITS = 20
SUSPECT_BITS = 27
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
BLANK = np.zeros(0x3002, bool)
BLANK[:33] = BLANK[[0x7F, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK[0x2000:0x200C] = True


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points, the place of each in the lower-cased text); no code point is zero."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = BLANK[np.minimum(codes, np.uint32(len(BLANK) - 1))]
    keep = np.flatnonzero(~(blank & np.concatenate(([True], blank[:-1]))) if len(codes) else blank)
    codes = np.where(blank, np.uint32(32), codes)[keep]
    if len(codes) > RUN:
        same = codes[1:] == codes[:-1]
        again = same[RUN - 1 :].copy()
        for k in range(RUN - 1):
            again &= same[k : len(same) - RUN + 1 + k]
        stay = np.concatenate((np.ones(RUN, bool), ~again))
        codes, keep = codes[stay], keep[stay]
    return codes, keep


def folded_item(text: str) -> np.ndarray:
    codes = folded(text)[0]
    return codes[:-1] if len(codes) and codes[-1] == 32 else codes


def as_text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of every q-gram (q a power of two), by doubling."""
    h, power, width = codes.astype(np.uint64) + np.uint64(1), BASE, 1
    with np.errstate(over="ignore"):
        while width < Q:
            h = h[:-width] * power + h[width:] if len(h) > width else h[:0]
            power, width = power * power, 2 * width
        return h * MIX


class Patterns:
    """The segments and parts of a block of items, indexed by q-gram; short items by their text."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.codes, budget = [], [], []
        self.short: dict[str, set[int]] = {}
        for item_id, text in items:
            codes = folded_item(text)
            if len(codes) < MIN_ITEM:
                if len(codes):
                    self.short.setdefault(as_text(codes), set()).add(item_id)
                continue
            for width, stride in ((SEGMENT, STRIDE), (PART, PART_STRIDE)):
                if width == PART and len(codes) <= PART:
                    continue
                last = max(0, len(codes) - width)
                for start in sorted({*range(0, last, stride), last}):
                    self.item.append(item_id)
                    self.codes.append(codes[start : start + width])
                    budget.append(0 if width == PART and len(codes) <= SEGMENT else int(len(self.codes[-1]) * ERRORS))
        self.length = np.array([len(c) for c in self.codes], np.int64)
        self.budget = np.array(budget, np.int64)
        self.least = np.maximum(1, self.length + 1 - Q * (self.budget + 1))
        hashes = [gram_hashes(c) for c in self.codes]
        every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(first, len(every))).astype(np.int32)
        self.first = first.astype(np.int32)
        self.segment = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(h) for h in hashes])[order]
        self.offset = np.concatenate([*[np.arange(len(h)) for h in hashes], np.zeros(0, np.int64)])[order].astype(np.int16)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True
        self.pad = int(self.budget.max(initial=0)) + Q

    def __bool__(self) -> bool:
        return bool(len(self.grams) or self.short)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for text, ids in self.short.items():
            found.add_word(text, (len(text), ids))
        found.make_automaton()
        return found

    def short_hits(self, codes: np.ndarray) -> dict[int, int]:
        """{item: place after its first occurrence} of the short items that stand between word boundaries."""
        text, out = as_text(codes), {}
        for last, (size, ids) in self.automaton.iter(text):
            low, high = last - size + 1, last + 1
            if not (low and text[low].isalnum() and text[low - 1].isalnum()) and not (high < len(text) and text[last].isalnum() and text[high].isalnum()):
                for i in ids:
                    out.setdefault(i, high)
        return out

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the q-gram) of every q-gram of the text that a segment has, in order."""
        places, grams = [], []
        for start in range(0, max(1, len(codes) - Q + 1), SLICE):
            h = gram_hashes(codes[start : start + SLICE + Q - 1])
            at = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
            found = np.searchsorted(self.grams, h[at])
            same = self.grams[np.minimum(found, len(self.grams) - 1)] == h[at]
            places.append(at[same] + start)
            grams.append(found[same])
        return np.concatenate(places), np.concatenate(grams)

    def bands(self, codes: np.ndarray):
        """(segment, first diagonal, q-grams shared) of the bands that reach the lemma's bound, lot by lot. A cell is as
        many diagonals as a segment's budget and one; a band is two cells. What no later place can
        add to is judged and forgotten."""
        place, gram = self.hits(codes)
        many = self.count[gram].astype(np.int64)
        total = np.cumsum(many)
        shift = SEGMENT + 1  # diagonals may start before the text
        reach = np.int64(len(codes) + 2 * SEGMENT + 2)
        cells, counts, low = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        while low < len(place):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + LOT, side="right")))
            n = many[low:high]
            entry = np.repeat(self.first[gram[low:high]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            segment = self.segment[entry].astype(np.int64)
            diagonal = np.repeat(place[low:high], n) - self.offset[entry]
            fresh_cells, fresh_counts = np.unique(segment * reach + (diagonal + shift) // (self.budget[segment] + 1), return_counts=True)
            if len(cells):
                every = np.concatenate((cells, fresh_cells))
                cells, of = np.unique(every, return_inverse=True)
                counts = np.bincount(of, np.concatenate((counts, fresh_counts))).astype(np.int64)
            else:
                cells, counts = fresh_cells, fresh_counts
            joined = counts.copy()
            joined[:-1] += np.where(cells[1:] == cells[:-1] + 1, counts[1:], 0)
            # a band that starts in an empty cell holds no more than the band after it
            seg, step = cells // reach, self.budget[cells // reach] + 1
            start = cells % reach * step - shift
            done = start + 2 * step + SEGMENT < place[high] if high < len(place) else np.ones(len(cells), bool)
            good = done & (joined >= self.least[seg])
            if good.any():
                yield seg[good], start[good], joined[good]
            # the first cell that isn't done needs no cell before it
            cells, counts, low = cells[~done], counts[~done], high

    def align(self, codes: np.ndarray, segment: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each segment inside its band, and the place after the match: all rows of
        the bands at once, one character of the segments at a time."""
        budget, length = self.budget[segment], self.length[segment]
        low = diagonal - budget
        width = int((2 * (budget + 1) + 2 * budget).max()) + 1
        lanes = np.arange(width)
        padded = np.concatenate([np.zeros(SEGMENT + width, np.uint32), codes, np.zeros(2 * SEGMENT + width, np.uint32)])
        pattern = np.zeros((len(segment), int(length.max())), np.uint32)
        for r, s in enumerate(segment):
            pattern[r, : self.length[s]] = self.codes[s]
        cost = np.zeros((len(segment), width), np.int64)
        best, end = np.full(len(segment), 1 << 30), np.zeros(len(segment), np.int64)
        for i in range(1, pattern.shape[1] + 1):
            j = low[:, None] + lanes + i  # text characters consumed
            change = cost + (padded[j - 1 + SEGMENT + width] != pattern[:, i - 1, None])
            change[:, :-1] = np.minimum(change[:, :-1], cost[:, 1:] + 1)
            cost = np.minimum.accumulate(change - lanes, axis=1) + lanes
            ended = length == i
            if ended.any():
                lane = cost[ended].argmin(axis=1)
                best[ended], end[ended] = cost[ended].min(axis=1), low[ended] + lane + i
        return best, end


def search(texts: list[str | None], patterns: Patterns) -> list[tuple[int, int, int, int, int]]:
    """(index of the text, item, edits of its best segment, segments and parts found, place after the
    best match in the lower-cased text), sorted. The best match is that of the longest, then of the
    least edits. Once a segment is found in a text, places there that share no more q-grams with it than
    the one found are passed over."""
    found: dict[tuple[int, int], list] = {}
    if not patterns:
        return []
    gap = np.zeros(2 * patterns.pad, np.uint32)  # longer than any budget: no match spans two texts
    for first, group in _groups(texts):
        parts, places, starts, at = [], [], [], 0
        for i, text in enumerate(group):
            codes, where = folded(text)
            starts.append(at)
            places.append(where)
            parts += [codes, gap]
            at += len(codes) + len(gap)
            if patterns.short:
                for item, z in patterns.short_hits(codes).items():
                    found[first + i, item] = [(0, 0), {-1}, int(where[z - 1]) + 1]
        if not len(patterns.grams):
            continue
        codes, begin, most = np.concatenate(parts), np.array(starts), {}
        for segments, diagonals, shares in patterns.bands(codes):
            for lot in range(0, len(segments), 2000):
                seg, diag, share = segments[lot : lot + 2000], diagonals[lot : lot + 2000], shares[lot : lot + 2000]
                of = np.searchsorted(begin, np.maximum(diag + patterns.length[seg] // 2, 0), side="right") - 1
                names, name = np.unique(of * np.int64(len(patterns.item)) + seg, return_inverse=True)
                open_ = share > np.array([most.get(n, -1) for n in names.tolist()])[name]
                if not open_.any():
                    continue
                seg, diag, share, name = seg[open_], diag[open_], share[open_], names[name[open_]]
                edits, end = patterns.align(codes, seg, diag)
                ok = edits <= patterns.budget[seg]
                for s, e, z, m, n in zip(seg[ok].tolist(), edits[ok].tolist(), end[ok].tolist(), share[ok].tolist(), name[ok].tolist(), strict=True):
                    most[n] = max(m, most.get(n, -1))
                    t = int(np.searchsorted(begin, max(0, z - 1), side="right")) - 1
                    inside = places[t]
                    stop = int(inside[min(max(z - starts[t], 1), len(inside)) - 1]) + 1
                    rank = (-int(patterns.length[s]), e)
                    entry = found.setdefault((first + t, patterns.item[s]), [rank, set(), stop])
                    entry[1].add(s)
                    if rank < entry[0]:
                        entry[0], entry[2] = rank, stop
    return sorted((i, item, rank[1], len(segs), end) for (i, item), (rank, segs, end) in found.items())


def _groups(texts: list[str | None]):
    """Texts in runs of about a million characters, with the index of the first."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE:
            yield start, [t or "" for t in texts[start : i + 1]]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, [t or "" for t in texts[start:]]


def blocks(benchmark: DataFrame) -> list:
    """A function for each block of (item_id, text) that fetches it; each is of bounded size."""
    usable = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.length(F.trim("text")) > 0).distinct()
    total = usable.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)

    def fetch(block: int) -> list[tuple[int, str]]:
        part = usable if n == 1 else usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        return sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r))

    return [lambda block=block: fetch(block) for block in range(n)]


def suspects(docs: DataFrame, fetches: list) -> DataFrame:
    """The rows that may hold an item of any block: somewhere in the length of a segment they have as many
    q-grams of the benchmark as the weakest bound asks for. Short items need every row."""
    bits, need, pad = np.zeros(1 << (SUSPECT_BITS - 3), np.uint8), 1 << 30, 0
    for fetch in fetches:
        block = Patterns(fetch())
        if block.short:
            return docs
        slot = (block.grams >> np.uint64(64 - SUSPECT_BITS)).astype(np.int64)
        np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
        need, pad = min(need, int(block.least.min(initial=need))), max(pad, block.pad)
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    span = SEGMENT + pad

    def may(text: str | None) -> bool:
        codes, known = folded(text or "")[0], np.frombuffer(shared.value, np.uint8)
        for start in range(0, len(codes), SLICE):
            slot = (gram_hashes(codes[start : start + SLICE + span]) >> np.uint64(64 - SUSPECT_BITS)).astype(np.int64)
            total = np.concatenate(([0], np.cumsum(known[slot >> 3] >> (slot & 7) & 1)))
            if (total[min(span, len(total) - 1) :] - total[: max(1, len(total) - span)]).max() >= need:
                return True
        return False

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([may(t.as_py()) for t in batch.column("text")], pa.bool_()))

    picked = settle(map_batches(docs, run, docs.schema), "suspects")
    shared.unpersist()
    return picked


def find(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each document row and item it holds: the kept columns, item_id, edits (of the best
    match), segments (and parts found), match_end (place after the best match, in characters of the
    lower-cased text)."""
    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    schema = f"{types}, item_id bigint, edits bigint, segments bigint, match_end bigint"
    fetches, out = blocks(benchmark), None
    if len(fetches) > 1:
        kept = suspects(kept, fetches)
    for fetch in fetches:
        shared = docs.sparkSession.sparkContext.broadcast(Patterns(fetch()))

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            rows = search(batch.column("text").to_pylist(), shared.value)
            index = pa.array([r[0] for r in rows], pa.int64())
            columns = [batch.column(c).take(index) for c in keep] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5)]
            return pa.RecordBatch.from_arrays(columns, [*keep, "item_id", "edits", "segments", "match_end"])

        part = map_batches(kept, run, schema)
        if len(fetches) > 1:
            part = settle(part, "leaks")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = kept.select(*keep).limit(0).select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("item_id", "edits", "segments", "match_end")])
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns; of a benchmark of one block without
    a shuffle."""
    fetches = blocks(benchmark)
    if not fetches:
        return docs
    if len(fetches) > 1:
        k1, k2 = row_key("text", "text")  # rows of one text share their fate
        a, b = fresh(docs.columns, "k1", "k2")
        leaked = find(docs.select(k1.alias(a), k2.alias(b), "text"), benchmark, (a, b)).select(a, b).distinct()
        return docs.withColumns({a: k1, b: k2}).join(leaked, [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(Patterns(fetches[0]()))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean_rows = np.ones(batch.num_rows, bool)
        clean_rows[[r[0] for r in search(batch.column("text").to_pylist(), shared.value)]] = False
        return batch.filter(pa.array(clean_rows))

    return map_batches(docs, run, docs.schema)

"""Removal of long repeated strings, found with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else, in the same text or another one.

1. Anchors: in each run of ``LENGTH`` bytes the 32-byte window with the least
   hash, leftmost on ties. Equal strings choose equal anchors at equal places, so
   a repeated string has an anchor that occurs more than once. Only such anchors
   and their contexts (``REACH`` bytes to the left, as many to the right) go on.
2. Equal contexts of an anchor meet by aggregation: where one occurs twice, all
   strings in it that hold the anchor are repeated.
3. Anchors with different contexts are put into shards. A shard's contexts, read
   to the right and to the left of the anchor, are ordered by suffix arrays
   (Larsson-Sadakane refinement), Kasai's walk gives their common prefixes. A
   string that reaches l bytes to the left of the anchor is repeated if another
   context agrees on l bytes to the left and LENGTH - 32 - l to the right.
4. An anchor with too many different contexts for a shard is spread over up to
   ``MOST_PARTS``, and any two of these are merged by binary search. One with more
   is told apart by longer strings: of two contexts that share a string, half of
   what lies around the anchor is equal on the left or on the right, so each goes
   into two groups by these halves, and again while a group is too large, at most
   eight times. Contexts that are equal as far as a group's strings reach are
   settled there and go on as one.
5. The runs found are gathered per document, merged and cut out.

Defined results: null and empty texts and texts shorter than ``LENGTH`` bytes
lose nothing. Twin rows (equal id and text) are copies of each other like any
equal texts; their places are gathered once for all of them. Texts of any length
are taken whole. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import suffix_arrays as sa
from pairloom.llm.anchors import WIDTH, leftmost_minima, window_hashes
from pairloom.llm.common import lean, map_batches, packed, row_key, unpacked
from pairloom.llm.shingles import B, B_INVERSE, _power, mix
from pairloom.session import Scratch, worker_path

LENGTH = 200
REACH = LENGTH - WIDTH
CHUNK = 1 << 20
SHARD_CONTEXTS, SPLIT_CONTEXTS, MOST_PARTS = 20_000, 2048, 4


def anchor_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place, anchor hash, context hash) of the anchors of some texts, taken as one run
    of bytes; windows that would cross from text to text are left out."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(sizes) - sizes
    h = window_hashes(codes)
    at = leftmost_minima(h, REACH + 1)
    of = np.searchsorted(starts, at, side="right") - 1
    inside = (at + WIDTH <= starts[of] + sizes[of]) & (sizes[of] >= LENGTH)
    at, of = at[inside], of[inside]
    low, high = np.maximum(at - REACH, starts[of]), np.minimum(at + LENGTH, starts[of] + sizes[of])
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _power(B, len(codes)), dtype=np.uint64)))
        context = mix((total[high] - total[low]) * _power(B_INVERSE, len(codes) + 1)[low])
        context = mix(context + ((at - low) * 512 + high - low).astype(np.uint64))
    return of, at - starts[of], h[at], context


def anchors(keyed: DataFrame) -> DataFrame:
    """(a, ctx, k1, k2, p) from rows of (k1, k2, text)."""

    def run(batch: pa.RecordBatch):
        k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
        group, first, size = [], 0, 0
        for i, text in enumerate(batch.column("text")):
            data = (text.as_py() or "").encode()
            group.append(data)
            size += len(data)
            if size >= CHUNK or i == batch.num_rows - 1:
                if size >= LENGTH:
                    of, at, a, ctx = anchor_places(group)
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(k1[first + of]), pa.array(k2[first + of]), pa.array(at.astype(np.int32))], ["a", "ctx", "k1", "k2", "p"])
                group, first, size = [], i + 1, 0

    return map_batches(keyed, run, "a bigint, ctx bigint, k1 bigint, k2 bigint, p int")


def contexts(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(a, ctx, left, data, ns) for wanted places (k1, k2, p, a, ctx, ns); left tells how many bytes of
    the context lie before the anchor."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("p", "a", "ctx", "ns")).alias("want"))
    # merged, twins come one after the other, and one of them is enough
    found = packed(keyed, "k1", "k2").join(lists.hint("merge"), ["k1", "k2"]).select("k1", "k2", "size", "blob", "want")
    last: list[tuple[int, int]] = [(0, 0)]

    def run(batch: pa.RecordBatch):
        for k1, k2, data, want in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), unpacked(batch), batch.column("want"), strict=True):
            if last[0] == (k1, k2):
                continue
            last[0] = (k1, k2)
            fields = pa.RecordBatch.from_struct_array(want.values)
            places = fields.column("p").to_pylist()
            cut = [data[max(0, p - REACH) : p + LENGTH] for p in places]
            left = [min(p, REACH) for p in places]
            yield pa.RecordBatch.from_arrays([fields.column("a"), fields.column("ctx"), pa.array(left, pa.int32()), pa.array(cut, pa.binary()), fields.column("ns")], ["a", "ctx", "left", "data", "ns"])

    return map_batches(found, run, "a bigint, ctx bigint, left int, data binary, ns int")


def _sides(left: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes behind the anchor, bytes before it read backwards, both padded; length behind it."""
    after, before = np.zeros((len(data), REACH), np.uint8), np.zeros((len(data), REACH), np.uint8)
    reach = np.zeros(len(data), np.int64)
    for r, (n, d) in enumerate(zip(left.tolist(), data, strict=True)):
        codes = np.frombuffer(d, np.uint8)
        tail = codes[n + WIDTH :]
        after[r, : len(tail)], reach[r] = tail, len(tail)
        before[r, :n] = codes[:n][::-1]
    return after, before, reach


def _order(strings: np.ndarray, anchor: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows in order, bytes in common with the one before; -1 where another anchor begins)."""
    orders, words = [], None
    for part in parts:
        words = sa.as_words(strings[part], anchor[part])
        order, common = sa.order_rows(words)
        orders.append(part[order])
    if len(orders) == 1:
        order = orders[0]
        # the suffix array knows the common words; the bytes of the first word that differs remain
        picked = strings[order]
        known = np.maximum(common - 1, 0) * 8
        column = np.minimum(known[:, None] + np.arange(8), REACH - 1)
        if len(order):
            prev = np.concatenate((order[:1], order[:-1]))
            equal = np.take_along_axis(picked, column, 1) == np.take_along_axis(strings[prev], column, 1)
            more = np.where(equal.all(axis=1), 8, np.argmin(equal, axis=1))
            common = np.minimum(known + more, REACH)
    else:
        order = sa.merge_orders(strings, *orders)  # the rows of one anchor: those of two shards
        common = sa.byte_prefix(strings, order)
    changed = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1])) if len(order) else np.zeros(0, bool)
    return order, np.where(changed, -1, common)


def repeated_reach(anchor: np.ndarray, left: np.ndarray, data: list[bytes], side: np.ndarray | None = None) -> np.ndarray:
    """For each context (rows) and l (0 to REACH): whether the string that reaches l bytes to the left
    of the anchor is in another context too; with ``side``, in one of the other side."""
    after, before, behind = _sides(left, data)
    every = np.arange(len(data))
    parts = [every] if side is None else [np.flatnonzero(side == s) for s in (0, 1)]
    (ro, rc), (lo, lc) = _order(after, anchor, parts), _order(before, anchor, parts)
    out = np.zeros((len(data), REACH + 1), bool)
    right, back = np.empty(len(data), np.int64), np.empty(len(data), np.int64)
    for n in range(REACH + 1):
        valid = np.flatnonzero((left >= n) & (behind >= REACH - n))
        if len(valid) < 2:
            continue
        right[ro] = np.cumsum(rc < REACH - n)
        back[lo] = np.cumsum(lc < n)
        key = right[valid] * np.int64(len(data) + 1) + back[valid]
        order = np.argsort(key, kind="stable")
        key, rows = key[order], valid[order]
        same = key[1:] == key[:-1]
        if side is None:
            out[rows[1:][same], n] = out[rows[:-1][same], n] = True
        else:
            group = np.cumsum(np.concatenate(([True], ~same))) - 1
            both = (np.bincount(group, side[rows] == 0) > 0) & (np.bincount(group, side[rows] == 1) > 0)
            out[rows[both[group]], n] = True
    return out


def runs_of(reach: np.ndarray) -> list[int]:
    """Starts and ends, relative to the anchor, of the bytes that the strings cover."""
    n = np.flatnonzero(reach)
    if not len(n):
        return []
    starts = -n[::-1]
    new = np.concatenate(([True], starts[1:] > starts[:-1] + LENGTH))
    first = starts[new]
    last = np.concatenate((starts[np.flatnonzero(new)[1:] - 1], starts[-1:])) + LENGTH
    return np.stack([first, last], 1).ravel().tolist()


def shard_results(found: DataFrame, total: int) -> DataFrame:
    """(a, ctx, runs) for contexts with a string repeated in another context of their group: those of one
    ``key``, which no more than ``MOST_PARTS`` shards hold."""
    worker_path(found.sparkSession)
    shards = max(1, -(-total // SHARD_CONTEXTS))
    own = F.when(F.col("ns") > 1, F.pmod(F.xxhash64("ctx"), F.col("ns"))).otherwise(0).cast("int")
    hot = F.when(F.col("ns") > 1, F.col("key"))
    bucket = F.when(F.col("ns") > 1, -1).otherwise(F.pmod(F.xxhash64("key"), F.lit(shards))).cast("int")
    placed = found.withColumns({"own": own, "hot": hot, "bucket": bucket})
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ns") - 1)))
    rows = other.select("bucket", "hot", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "a", "ctx", "left", "data")

    def run(group: pa.Table) -> pa.Table:
        lean()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        own = group["own"].to_numpy()
        reach = repeated_reach(group["key"].to_numpy(), group["left"].to_numpy().astype(np.int64), group["data"].to_pylist(), None if i == j else (own == j).astype(np.int64))
        hit = np.flatnonzero(reach.any(axis=1))
        return pa.table({"a": group["a"].take(hit), "ctx": group["ctx"].take(hit), "runs": pa.array([runs_of(reach[r]) for r in hit], pa.list_(pa.int32()))})

    return rows.groupBy("bucket", "hot", "i", "j").applyInArrow(run, "a bigint, ctx bigint, runs array<int>")


def parts_of(n):
    return F.ceil(n / SPLIT_CONTEXTS).cast("int")


def narrowed(hot: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """For contexts (a, ctx, left, data) of anchors with very many: (groups by longer shared strings that
    shards can hold, runs that need no shard). A group shares ``x`` bytes before and ``y`` behind the
    anchor, so its strings reach over at most REACH - y and REACH - x. Contexts that are equal in all
    of that are repeated with all strings of the group at once, and one of them stands for them."""
    rows = hot.select("a", "ctx", "left", "data", F.lit(0).alias("x"), F.lit(0).alias("y"))
    small = whole = None
    while not rows.isEmpty():
        half = F.ceil((F.lit(REACH) - F.col("x") - F.col("y")) / 2).cast("int")
        two = F.explode(F.array(F.struct((F.col("x") + half).alias("x"), F.col("y").alias("y")), F.struct(F.col("x").alias("x"), (F.col("y") + half).alias("y"))))
        kids = rows.select("a", "ctx", "left", "data", two.alias("s")).select("a", "ctx", "left", "data", "s.x", "s.y")
        right = F.octet_length("data") - F.col("left") - WIDTH
        kids = kids.where((F.col("left") >= F.col("x")) & (right >= F.col("y")))
        shared = F.substring("data", F.col("left") - F.col("x") + 1, F.col("x") + F.col("y") + WIDTH)
        most, least = F.least(F.col("left"), F.lit(REACH) - F.col("y")), F.greatest(F.col("x"), F.lit(REACH) - right)
        reach = F.substring("data", F.col("left") - most + 1, most + WIDTH + F.least(right, F.lit(REACH) - F.col("x")))
        keyed = kids.withColumns({"key": F.xxhash64("a", "x", "y", shared), "all": F.xxhash64(most, reach), "most": most, "least": least}).where("least <= most")
        kids = scratch.settle(keyed, "sa-kids")
        equal = scratch.settle(kids.groupBy("key", "all").agg(F.min("ctx").alias("first"), F.count("*").alias("n")), "sa-equal")
        sizes = scratch.settle(equal.groupBy("key").agg(F.count("*").alias("g")).where("g > 1"), "sa-sizes")
        several = equal.where("n > 1").select("key", "all")
        ended = kids.join(several, ["key", "all"]).select("a", "ctx", F.array(-F.col("most"), F.lit(LENGTH) - F.col("least")).alias("runs"))
        stand = kids.join(equal.join(sizes, "key").select("key", "all", "first", "g"), ["key", "all"]).where("ctx = first")
        fits = parts_of(F.col("g")) <= MOST_PARTS
        held = stand.where(fits).select("key", "a", "ctx", "left", "data", parts_of(F.col("g")).alias("ns"))
        whole, small = (ended, held) if whole is None else (whole.union(ended), small.union(held))
        rows = scratch.settle(stand.where(~fits).select("a", "ctx", "left", "data", "x", "y"), "sa-hot")
    return small, whole


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(k1, k2, whole, parts) per document: places of anchors all of whose strings are repeated, and
    runs (starts and ends in turn, absolute) of the others."""
    spark = docs.sparkSession
    scratch, last = Scratch(spark), Scratch(spark)
    k1, k2 = row_key("doc_id", "text")
    keyed = docs.where(F.octet_length("text") >= LENGTH).select(k1.alias("k1"), k2.alias("k2"), "text")
    first = Scratch(spark)
    every = first.settle(anchors(keyed), "sa-anchors")
    often = first.settle(every.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "sa-often")
    met = scratch.settle(every.join(often, "a"), "sa-met")
    first.clear()
    same = scratch.settle(met.groupBy("a", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "p")).alias("rep")), "sa-same")
    several = scratch.settle(same.groupBy("a").agg(F.count("*").alias("g")).where("g > 1"), "sa-several")
    mixed = scratch.settle(same.join(several, "a").select("rep.*", "a", "ctx", "n", parts_of(F.col("g")).alias("ns")), "sa-mixed")
    counts = mixed.agg(F.count("*"), F.count_if(F.col("ns") > MOST_PARTS)).first()
    found = contexts(keyed, mixed.drop("n").where(F.col("ns") <= MOST_PARTS)).withColumn("key", F.col("a"))
    partly = scratch.settle(shard_results(found, counts[0]), "sa-parts")
    if counts[1]:
        hot = scratch.settle(contexts(keyed, mixed.drop("n").where(F.col("ns") > MOST_PARTS)), "sa-hot")
        small, ended = narrowed(hot, scratch)
        runs = shard_results(small, 2 * counts[1]).union(ended).groupBy("a", "ctx").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        partly = partly.union(scratch.settle(runs, "sa-parts"))
    # places as a set: twins have the same
    whole = met.join(same.where("n > 1").select("a", "ctx"), ["a", "ctx"], "left_semi")
    whole = whole.groupBy("k1", "k2").agg(F.collect_set("p").alias("whole"))
    absolute = F.transform("runs", lambda r: r + F.col("p"))
    alone = mixed.where("n = 1").join(partly, ["a", "ctx"]).groupBy("k1", "k2").agg(F.flatten(F.collect_list(absolute)).alias("parts"))
    runs = last.settle(whole.join(alone, ["k1", "k2"], "full_outer"), "sa-runs")
    scratch.clear()
    return runs


def merged_runs(size: int, whole: list[int] | None, parts: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs to remove from a text of ``size`` bytes."""
    whole, parts = np.array(whole or [], np.int64), np.array(parts or [], np.int64)
    start = np.concatenate([np.maximum(whole - REACH, 0), parts[::2]])
    end = np.concatenate([np.minimum(whole + LENGTH, size), parts[1::2]])
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes (binary: what is left, which need not be UTF-8
    any more) per row."""
    return _apply(docs, False)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row."""
    return _apply(docs, True)


def _apply(docs: DataFrame, hashed: bool) -> DataFrame:
    k1, k2 = row_key("doc_id", "text")
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", k1.alias("k1"), k2.alias("k2"))
    runs = repeated_runs(docs.select("doc_id", "text"))
    joined = packed(slim, "doc_id", "k1", "k2").join(runs, ["k1", "k2"], "left").select("doc_id", "size", "blob", "whole", "parts")
    last, kind = ("kept_sha256", pa.string()) if hashed else ("kept_bytes", pa.binary())

    def run(batch: pa.RecordBatch):
        rows = []
        for data, whole, parts in zip(unpacked(batch), batch.column("whole"), batch.column("parts"), strict=True):
            start, end = merged_runs(len(data), whole.as_py(), parts.as_py())
            kept = b"".join(data[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(data)], strict=True))
            rows.append((len(data), len(data) - len(kept), len(start), hashlib.sha256(kept).hexdigest() if hashed else kept))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = [pa.int64()] * 3 + [kind]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", last])

    return map_batches(joined, run, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, {last} {'string' if hashed else 'binary'}")

"""Near-duplicates by bottom-k sketches of word shingles, confirmed on full sets.

1. Each text becomes its set of distinct word shingles; one hash function orders
   them, the K least are its sketch. Texts with equal sets form a class, and one
   sketch stands for the class from here on.
2. Inverted lists: each sketch value that several classes retain lists them. Two
   sets as similar as asked share a certain part of their sketches, so they meet in a
   list even if each class enters only the rarest values of its sketch (all but
   that part, and one more). Common passages drop out there.
3. Every list is compared with one pivot, its class with the most widely shared
   sketch, by the union-sketch estimate of their similarity. As the distance
   1 - similarity is a metric, classes near the pivot can only be linked with
   classes not far from it: both form the pivot's canopy. List members that are
   not near go through the same with pivots of their own; what is left after
   ``ROUNDS`` is estimated pair by pair, in blocks.
4. In a canopy that fits a block the exact intersections of all pairs of full sets
   are counted at once, and the links go out as a spanning forest. In a larger one
   every member is compared with the pivot, block by block. Most members of a group
   of near copies are linked with it. The others can only be linked with sets that
   differ from the pivot in the same places, at least once: so of each member only
   its differences from the pivot go on, lists of the rarest differences (as many as
   a link may leave out, and one more) bring members together, and their exact
   similarity follows from the differences they share.
5. The links' connected components give the groups.

Sketches are random: a pair right at the threshold is missed with a chance of
about 1e-5, since all bounds are four standard errors away from it.

Defined results: null and empty texts and texts without words have no shingle,
are linked with nothing and are their own group. Rows with a null id take part;
they name no group unless no member has an id (then component_id is null, and
they are kept). Rows that share an id and are in one group are all kept or all
dropped by :func:`groups`; :func:`drop_copies` keeps one of twin rows (equal id and
text). Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import fresh, lean, map_batches, packed, row_key, split_twins, twin_keys, unpacked
from pairloom.llm.components import components
from pairloom.llm.shingles import shingle_sets
from pairloom.session import Scratch, settle, worker_path

K = 48
NEAR = 0.72  # estimated similarity to the pivot of what needs no other pivot
ERROR, ERROR_OF_TWO = 0.23, 0.19  # four standard errors: of an estimate; of the difference of two alike
ROUNDS = 3
BLOCK_CLASSES, BLOCK_SHINGLES = 256, 1 << 19
PAIR_BLOCK = 512
BIT_ROWS = 1024


def sketched(docs: DataFrame, size: int, k: int = K) -> DataFrame:
    """(k1, k2, doc_id, n, c, sketch): c names the set by 128 bits."""
    k1, k2 = row_key("doc_id", "text")
    slim = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, c1, c2, sketches = [], [], [], []
        for s in shingle_sets(batch.column("text").to_pylist(), size):
            a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
            n.append(len(s))
            c1.append(int(a))
            c2.append(int(b))
            sketches.append(s[:k].copy())  # not a view that keeps the whole set
        return pa.RecordBatch.from_arrays(
            [*[batch.column(x) for x in ("k1", "k2", "doc_id")], pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))],
            ["k1", "k2", "doc_id", "n", "c1", "c2", "sketch"],
        )

    made = map_batches(slim, run, "k1 bigint, k2 bigint, doc_id bigint, n bigint, c1 bigint, c2 bigint, sketch array<bigint>")
    return made.select("k1", "k2", "doc_id", "n", F.struct("c1", "c2").alias("c"), "sketch")


def least_estimate(percent: int) -> float:
    """What the sketches of linked sets share, and their estimate is, at least."""
    return percent / 100 - ERROR


def inverted_lists(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(x, c, pop): the rarest retained values of each class that others retain too; pop tells how
    widely the class's values are shared."""
    # narrow rows: the join that follows moves one for each value of each sketch
    entries = classes.select("c.c1", "c.c2", F.explode("sketch").alias("x"))
    shared = scratch.settle(entries.groupBy("x").agg(F.count("*").alias("df")).where("df > 1"), "nd-shared")
    held = entries.join(shared, "x").groupBy("c1", "c2").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("held"))
    held = held.select(F.struct("c1", "c2").alias("c"), "held").join(classes.select("c", F.size("sketch").alias("q")), "c")
    # values of this class alone are the rarest; they fill the first places
    places = F.col("q") - F.ceil(F.col("q") * least_estimate(percent)) + 1 - (F.col("q") - F.size("held"))
    listed = held.where(places > 0).select("c", F.aggregate("held", F.lit(0.0), lambda a, h: a + F.log2(h["df"])).alias("pop"), F.explode(F.slice("held", 1, places.cast("int"))).alias("h"))
    return listed.select("h.x", "c", "pop")


def estimate(a: Column, b: Column, k: int = K) -> Column:
    """Similarity from the k least values of the union of two sketches."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)


def compare(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """(p, c, est) for distinct pairs."""
    left = sketches.select(F.col("c").alias("p"), F.col("sketch").alias("sp"))
    right = sketches.select("c", F.col("sketch").alias("sc"))
    return pairs.distinct().join(right, "c").join(left, "p").select("p", "c", estimate(F.col("sp"), F.col("sc")).alias("est"))


PAIRS = 4096  # estimated at once


def similar(sketches: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which pairs' union-sketch estimates reach a bound. ``sketches`` has a row for each, its values first."""
    out = np.zeros(len(x), bool)
    place = np.arange(sketches.shape[1])
    for at in range(0, len(x), PAIRS):
        a, b = x[at : at + PAIRS], y[at : at + PAIRS]
        both = np.concatenate((sketches[a], sketches[b]), axis=1)
        empty = np.concatenate((place >= sizes[a, None], place >= sizes[b, None]), axis=1)
        order = np.argsort(both, axis=1, kind="stable")
        both, empty = np.take_along_axis(both, order, 1), np.take_along_axis(empty, order, 1)
        # empty places hold the largest number there is; of equal values the filled come first
        order = np.argsort(empty, axis=1, kind="stable")
        both, empty = np.take_along_axis(both, order, 1), np.take_along_axis(empty, order, 1)
        twice = (both[:, 1:] == both[:, :-1]) & ~empty[:, 1:]
        rank = np.cumsum(np.concatenate((~empty[:, :1], ~twice & ~empty[:, 1:]), axis=1), axis=1)  # in the union
        size = np.minimum(K, rank[:, -1])
        out[at : at + PAIRS] = (twice & (rank[:, 1:] <= size[:, None])).sum(axis=1) >= least * size
    return out


def blocks_of(lists: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``lists`` (keys, c, ...) with blocks (i, j) and ``own``: long lists are cut into blocks, any
    two of which meet in one group, so a group stays small."""
    sizes = lists.groupBy(*keys).agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("nb"), F.count("*").alias("m")).where("m > 1").drop("m")
    placed = lists.join(sizes, keys).withColumn("own", F.pmod(F.xxhash64("c"), F.col("nb")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return other.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "nb")


def pair_blocks(lists: DataFrame, sketches: DataFrame, percent: int, rounds: int) -> DataFrame:
    """(p, c): all pairs within a list that shared no canopy in ``rounds`` rounds and may be linked by their estimate. Pairs
    whose sketches share too little for it are told by one matrix product."""
    worker_path(lists.sparkSession)
    least = least_estimate(percent)
    rows = blocks_of(lists, ["x"]).join(sketches, "c").select("x", "i", "j", "own", "out", "c.c1", "c.c2", "sketch")

    def run(group: pa.Table) -> pa.Table:
        lean()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        own, sketch = group["own"].to_numpy(), group["sketch"].combine_chunks()
        c1, c2, size = group["c1"].to_numpy(), group["c2"].to_numpy(), np.asarray(sketch.value_lengths())
        out, filled = group["out"].to_numpy(), np.full((len(size), K), 2**63 - 1)
        filled[np.arange(K) < size[:, None]] = sketch.values.to_numpy()
        hit = np.triu(shared_counts(sketch.values.to_numpy(), size) >= least * np.maximum(size[:, None], size[None, :]), 1)
        hit &= (out[:, None] | out[None, :]) == (1 << rounds) - 1
        if i != j:
            hit &= own[:, None] != own[None, :]
        x, y = np.nonzero(hit)
        good = similar(filled, size, x, y, least)
        x, y = x[good], y[good]
        return pa.table({"p1": pa.array(c1[x], pa.int64()), "p2": pa.array(c2[x], pa.int64()), "c1": pa.array(c1[y], pa.int64()), "c2": pa.array(c2[y], pa.int64())})

    made = rows.groupBy("x", "i", "j").applyInArrow(run, "p1 bigint, p2 bigint, c1 bigint, c2 bigint")
    return made.select(F.struct(F.col("p1").alias("c1"), F.col("p2").alias("c2")).alias("p"), F.struct("c1", "c2").alias("c")).distinct()


def apart(rounds: int) -> Column:
    """Of a list's row: whether ``masks``, what its members have in ``out``, name a partner with which it shared no
    canopy in ``rounds`` rounds. A bit of ``out`` is set for each round whose canopy a member wasn't in."""
    return F.exists("masks", lambda m: m.bitwiseOR(F.col("out")) == (1 << rounds) - 1)


def canopies(classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(p, c): memberships, such that any two similar classes share a p. p itself is a member."""
    sketches = classes.select("c", "sketch")
    lists = scratch.settle(inverted_lists(classes, percent, scratch).withColumn("out", F.lit(0)), "nd-lists")
    far = NEAR - (1 - percent / 100) - ERROR_OF_TWO
    found = None
    for n in range(ROUNDS):
        pivots = lists.groupBy("x").agg(F.max(F.struct("pop", "c")).alias("top"), F.count("*").alias("m"), F.collect_set("out").alias("masks")).where("m > 1")  # a few masks
        pivots = scratch.settle(pivots.select("x", F.col("top.c").alias("p"), "masks"), "nd-pivots")
        with_pivot = scratch.settle(lists.join(pivots, "x").where(apart(n)).drop("masks"), "nd-with-pivot")
        compared = scratch.settle(compare(with_pivot.where("p <> c").select("p", "c"), sketches), "nd-compared")
        member = compared.where(F.col("est") >= far).select("p", "c")
        found = member if found is None else found.union(member)
        away = compared.where(F.col("est") < NEAR).select("p", "c", F.when(F.col("est") < far, 1 << n).otherwise(0).alias("bit"))
        lists = with_pivot.join(away, ["p", "c"]).select("x", "c", "pop", F.col("out").bitwiseOR(F.col("bit")).alias("out"))
        lists = scratch.settle(lists, "nd-lists")
        if lists.isEmpty():
            break
    else:
        masks = scratch.settle(lists.groupBy("x").agg(F.collect_set("out").alias("masks")), "nd-masks")
        left = scratch.settle(lists.join(masks, "x").where(apart(ROUNDS)).drop("masks"), "nd-left")
        found = found.union(pair_blocks(left, sketches, percent, ROUNDS))
    found = scratch.settle(found.distinct(), "nd-canopies")
    return found.union(found.select("p", F.col("p").alias("c")).distinct())


def perhaps_among(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` (k1, k2, ...) that may be among ``keys``: all that are, few others while the
    keys are fewer than the bits. A bitmap of ``BIT_ROWS`` times 32,768 bits, at most 4 MB however many
    keys there are, spares most texts the shuffle of the join that follows."""
    place = F.pmod("k1", F.lit(BIT_ROWS)).cast("int")
    bit = F.pmod("k2", F.lit(32768)).cast("int")
    bits = keys.groupBy(place.alias("place")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), bit % 8 + 1)) > 0
    return docs.join(F.broadcast(bits), (place == F.col("place")) & is_set, "left_semi")


MADE = "p1 bigint, p2 bigint, c1 bigint, c2 bigint, linked boolean, n int, pn int, gone int, d array<bigint>"


def pair(one: str, two: str):
    return F.struct(F.col(one).alias("c1"), F.col(two).alias("c2"))


def confirmed_links(docs: DataFrame, classes: DataFrame, members: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): links between classes whose full sets have at least ``percent`` hundredths of their union in
    common, such that all others follow: a spanning forest of each small canopy; of a large one all links
    with its pivot, and forests of the links that its lists of differences bring up."""
    worker_path(docs.sparkSession)
    members = scratch.settle(members.join(classes.select("c", "n", "k1", "k2"), "c"), "nd-keyed")
    totals = members.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    needed = scratch.settle(members.join(scratch.settle(totals, "nd-totals"), "p"), "nd-members")
    keys = needed.select("k1", "k2", "c").distinct()
    k1, k2 = row_key("doc_id", "text")
    near = perhaps_among(docs.select(k1.alias("k1"), k2.alias("k2"), "text"), keys)
    texts = packed(near, "k1", "k2").join(keys, ["k1", "k2"]).select("c", "size", "blob")

    def run_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("c"), pa.array(list(shingle_sets(unpacked(batch), size)), pa.list_(pa.int64()))], ["c", "items"])

    sets = map_batches(texts, run_sets, "c struct<c1:bigint,c2:bigint>, items array<bigint>").dropDuplicates(["c"])
    # a large canopy's pivot goes to each of its blocks, every other member to one
    large, pivot = F.col("nb") > 1, F.col("c") == F.col("p")
    own = F.array(F.pmod(F.xxhash64("c"), F.col("nb")).cast("int"))
    placed = needed.select("p", "c", large.alias("large"), pivot.alias("pivot"), F.explode(F.when(large & pivot, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(own)).alias("block"))
    rows = placed.join(sets, "c").select("p.c1", "p.c2", "block", "large", "pivot", F.col("c.c1").alias("m1"), F.col("c.c2").alias("m2"), "items")

    def run(group: pa.Table) -> pa.Table:
        lean()
        items = group["items"].combine_chunks()
        values, lengths = items.values.to_numpy(), np.asarray(items.value_lengths())
        m1, m2 = group["m1"].to_numpy(), group["m2"].to_numpy()
        if not group["large"][0].as_py():
            common = shared_counts(values, lengths)
            x, y = forest(np.triu(100 * common >= percent * (lengths[:, None] + lengths[None, :] - common), 1))
            none = pa.nulls(len(x), pa.int32())
            return pa.table([m1[x], m2[x], m1[y], m2[y], pa.array([True] * len(x), pa.bool_()), none, none, none, pa.nulls(len(x), pa.list_(pa.int64()))], schema=made_schema)
        ends = np.cumsum(lengths)
        centre = int(np.flatnonzero(group["pivot"].to_numpy(zero_copy_only=False))[0])
        base = np.sort(values[ends[centre] - lengths[centre] : ends[centre]])
        out = []
        for r in range(len(lengths)):
            if r != centre:
                own = values[ends[r] - lengths[r] : ends[r]]
                gone, new = np.setdiff1d(base, own, assume_unique=True), np.setdiff1d(own, base, assume_unique=True)
                common = len(own) - len(new)
                out.append((m1[r], m2[r], 100 * common >= percent * (len(base) + len(new)), len(own), len(gone), np.concatenate((new, ~gone))))
        k = len(out)
        columns = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table([pa.array([m1[centre]] * k, pa.int64()), pa.array([m2[centre]] * k, pa.int64()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.int32()), pa.array([len(base)] * k, pa.int32()), pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.list_(pa.int64()))], schema=made_schema)

    made_schema = pa.schema([*[(c, pa.int64()) for c in ("p1", "p2", "c1", "c2")], ("linked", pa.bool_()), *[(c, pa.int32()) for c in ("n", "pn", "gone")], ("d", pa.list_(pa.int64()))])
    made = scratch.settle(rows.groupBy("c1", "c2", "block").applyInArrow(run, MADE), "nd-made")
    links = made.where("linked").select(pair("p1", "p2").alias("a"), pair("c1", "c2").alias("b"))
    if made.where("not linked").isEmpty():
        return links
    return links.union(links_by_differences(made.where("d is not null"), percent, scratch))


def links_by_differences(made: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): the links in large canopies that need not go through the pivot: at least one side isn't linked
    with it. ``made`` has each member's differences ``d`` from the pivot of ``pn`` shingles, ``gone``
    of which are shingles that the member lacks."""
    of = made.withColumns({"p": pair("p1", "p2"), "c": pair("c1", "c2")})
    open_ = scratch.settle(of.where("not linked").select("p").distinct(), "nd-open")
    of = of.join(open_, "p", "left_semi").select("p", "c", "linked", "n", "pn", "gone", "d")
    # two linked sets differ in as many shingles at most as this part of either
    slack = F.floor(F.col("n") * (100 - percent) / percent).cast("int")
    entries = of.select("p", "c", F.explode("d").alias("x"))
    shared = scratch.settle(entries.groupBy("p", "x").agg(F.count("*").alias("df")).where("df > 1"), "nd-differences")
    held = entries.join(shared, ["p", "x"]).groupBy("p", "c").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("held"))
    # differences of this member alone are the rarest; they fill the first places
    places = F.least(F.size("d"), slack + 1) - (F.size("d") - F.size("held"))
    listed = held.join(of.select("p", "c", "linked", "n", "d"), ["p", "c"]).where(places > 0).select("p", "c", "linked", F.explode(F.slice("held", F.lit(1), places)).alias("h"))
    lists = scratch.settle(listed.select("p", "h.x", "c", "linked"), "nd-lists")
    useful = lists.groupBy("p", "x").agg(F.count_if(~F.col("linked")).alias("free"), F.count("*").alias("m")).where("free > 0 and m > 1").select("p", "x")
    rows = blocks_of(lists.join(scratch.settle(useful, "nd-useful"), ["p", "x"], "left_semi").drop("linked"), ["p", "x"])
    rows = rows.join(of, ["p", "c"]).select("p", "x", "i", "j", "own", "c.c1", "c.c2", "linked", "n", "pn", "gone", "d")

    def run(group: pa.Table) -> pa.Table:
        lean()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        own, d = group["own"].to_numpy(), group["d"].combine_chunks()
        n, gone, base = group["n"].to_numpy(), group["gone"].to_numpy(), group["pn"][0].as_py()
        free = ~group["linked"].to_numpy(zero_copy_only=False).astype(bool)
        common = base - gone[:, None] - gone[None, :] + shared_counts(d.values.to_numpy(), np.asarray(d.value_lengths()))
        hit = np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1) & (free[:, None] | free[None, :])
        if i != j:
            hit &= own[:, None] != own[None, :]
        x, y = forest(hit)
        c1, c2 = group["c1"].to_numpy(), group["c2"].to_numpy()
        return pa.table({"a1": pa.array(c1[x], pa.int64()), "a2": pa.array(c2[x], pa.int64()), "b1": pa.array(c1[y], pa.int64()), "b2": pa.array(c2[y], pa.int64())})

    made = rows.groupBy("p", "x", "i", "j").applyInArrow(run, "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    return made.distinct().select(pair("a1", "a2").alias("a"), pair("b1", "b2").alias("b"))


def shared_counts(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many values any two of the sets, given one after the other, have in common."""
    n = len(lengths)
    row = np.repeat(np.arange(n), lengths)
    order = np.argsort(values, kind="stable")
    sorted_values, row = values[order], row[order]
    same = sorted_values[1:] == sorted_values[:-1]
    keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))  # shared by two sets at least
    if not len(values):
        keep = np.zeros(0, bool)
    row, first = row[keep], np.concatenate(([True], ~same))[: len(keep)][keep]
    column = np.cumsum(first) - 1
    common = np.zeros((n, n), np.float64)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        if high > low:
            part = np.zeros((n, width), np.float32)
            part[row[low:high], column[low:high] % width] = 1
            busy = np.flatnonzero(part.any(axis=1))
            part = part[busy]
            common[np.ix_(busy, busy)] += part @ part.T
    return common


def forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs that are set."""
    root = np.arange(len(hit))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    x, y = [], []
    for a, b in zip(*np.nonzero(hit), strict=True):
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
            x.append(a)
            y.append(b)
    return np.array(x, np.int64), np.array(y, np.int64)


def groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = settle(sketched(docs, size), "nd-rows")
    number = F.coalesce("doc_id", F.lit(2**63 - 1))
    least = F.min(F.struct(number.alias("low"), F.col("k1"), F.col("k2"), F.col("sketch"), F.col("n"))).alias("rep")
    # rows of one class meet as partial minima
    classes = rows.where("n > 0").groupBy("c").agg(least).select("c", "rep.low", "rep.k1", "rep.k2", "rep.sketch", "rep.n")
    classes = scratch.settle(classes, "nd-classes")
    links = scratch.settle(confirmed_links(docs, classes, canopies(classes, percent, scratch), size, percent, scratch), "nd-links")
    name = classes.select("c", F.struct(F.col("low"), F.col("c")).alias("node"))
    edges = links.join(name.select(F.col("c").alias("a"), F.col("node").alias("na")), "a").join(name.select(F.col("c").alias("b"), F.col("node").alias("nb")), "b")
    roots = components(edges.select(F.col("na").alias("a"), F.col("nb").alias("b")), scratch)
    low = classes.select("c", "low").join(roots.select(F.col("node.c").alias("c"), F.col("root.low").alias("root_low")), "c", "left").select("c", F.coalesce("root_low", "low").alias("component"))
    low = settle(low, "nd-components")
    scratch.clear()
    # a class of very many copies meets one row of its component; AQE can split it
    joined = rows.select("k1", "k2", "doc_id", "n", "c").join(low, "c", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.nullif(F.col("component"), F.lit(2**63 - 1)))
    out = joined.select("k1", "k2", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def digest(docs: DataFrame, size: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return groups(docs.select("doc_id", "text"), size, percent).select("doc_id", "n_shingles", "component_id", "kept")


def drop_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group, all columns; of twin rows (equal id and
    text) one."""
    k1, k2 = row_key("doc_id", "text")
    a, b = fresh(docs.columns, "k1", "k2")
    scratch = Scratch(docs.sparkSession)
    found = scratch.settle(groups(docs.select("doc_id", "text"), size, percent).select(F.col("k1").alias(a), F.col("k2").alias(b), "kept"), "nd-found")
    dropped = found.where(~F.col("kept")).select(a, b).distinct()
    left = docs.withColumns({a: k1, b: k2}).join(dropped, [a, b], "left_anti")
    single, one = split_twins(left, a, b, twin_keys(found.where("kept").select(a, b), a, b, scratch))
    if one is not None:
        single = single.unionByName(one.select("row.*"))
    return single.select(*[F.col(f"`{c}`") for c in docs.columns])

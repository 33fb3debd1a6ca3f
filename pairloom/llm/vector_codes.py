"""Vectors compressed to 16 codes of one byte: product quantisation in whole numbers.

A vector's components become ``floor(256 x)`` and are cut into 16 equal parts. The
codebook of each part's position starts as that part of the 64 smallest ids. In every round
the driver builds a kd-tree for each codebook (64 entries, however many vectors there are) and
broadcasts them; tasks find each part's nearest entry by branch and bound, a batch of
vectors at once, and add up whole numbers for each entry, which Spark sums. A box as far as the
best entry so far is still searched, so of equally near entries the least index stays.

All arithmetic is exact: batches whose numbers could leave 64 bits are computed with
Python's integers, and sums travel in digits of 40 bits. Only squared distances over
2^63 - 1, a result's limit, are given as 2^63 - 1.

Defined results: rows whose vector is null or empty or holds a null, NaN or infinite
component are dropped; so are those of another length than the first kept vector's (by id), which have no
parts that compare. A length that is no multiple of 16 is an error. Fewer than 64 kept rows
give smaller codebooks; a null id orders after all others, rows of one id by their vectors.
Repeated rows keep their multiplicity. An empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import lean, map_batches, small_batches
from pairloom.session import settle, worker_path

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
LEAF = 8  # entries of a leaf
SAFE = 1 << 24  # components below it: squared distances of 4,096 components, and sums over a batch, fit into 64 bits
DIGIT = 40  # bits
MOST = 2**63 - 1


class KdTree:
    """A kd-tree over a codebook (entries by dimensions), searched for many points at once."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, index: np.ndarray) -> tuple:
        """(lowest corner, highest corner, indices of a leaf or None, axis, cut, left, right)."""
        own = self.entries[index]
        low, high = own.min(axis=0), own.max(axis=0)
        axis = int(np.argmax(high - low))
        if len(index) <= LEAF or low[axis] == high[axis]:
            return low, high, np.sort(index), None, None, None, None
        order = index[np.argsort(own[:, axis], kind="stable")]
        half = len(order) // 2
        cut = self.entries[order[half], axis]
        return low, high, None, axis, cut, self._node(order[:half]), self._node(order[half:])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry; of equally near ones the least index."""
        kind = np.result_type(points, self.entries)
        best = np.full(len(points), len(self.entries), np.int64)
        distance = np.zeros(len(points), kind)

        def measure(leaf: np.ndarray, rows: np.ndarray) -> None:
            apart = points[rows][:, None, :] - self.entries[leaf][None, :, :]
            squared = (apart * apart).sum(axis=2)
            at = squared.argmin(axis=1)  # the first, hence least, of equals within the leaf
            d, i = squared[np.arange(len(rows)), at], leaf[at]
            b, have = best[rows], distance[rows]
            nearer = (b == len(self.entries)) | (d < have) | ((d == have) & (i < b))
            best[rows[nearer]], distance[rows[nearer]] = i[nearer], d[nearer]

        def descend(node: tuple, rows: np.ndarray) -> None:
            """To the leaf on whose side of every cut a point lies: a first bound."""
            if not len(rows):
                return
            _, _, leaf, axis, cut, left, right = node
            if leaf is not None:
                home[rows] = id(node)
                measure(leaf, rows)
                return
            below = points[rows, axis] < cut
            descend(left, rows[below])
            descend(right, rows[~below])

        def search(node: tuple, rows: np.ndarray) -> None:
            """All boxes that are no farther than the best so far; at equal distance a lower index may lie inside."""
            low, high, leaf, _, _, left, right = node
            own = points[rows]
            out = np.maximum(np.maximum(low - own, own - high), 0)
            rows = rows[(out * out).sum(axis=1) <= distance[rows]]
            if leaf is not None:
                rows = rows[home[rows] != id(node)]
                if len(rows):
                    measure(leaf, rows)
            elif len(rows):
                search(left, rows)
                search(right, rows)

        home = np.zeros(len(points), np.int64)
        everyone = np.arange(len(points))
        descend(self.root, everyone)
        search(self.root, everyone)
        return best, distance


def whole_numbers(vectors: list[list[float]]) -> np.ndarray:
    """floor(256 x), in 64 bits where squares and sums fit, else as Python's integers."""
    x = np.array(vectors, np.float64) * SCALE  # a power of two: exact
    if not x.size or np.abs(x).max() < SAFE:
        return np.floor(x).astype(np.int64)
    return np.array([[math.floor(v) for v in row] for row in x.tolist()], object)


def numbers(rows: list[list[int]]) -> np.ndarray:
    """Whole numbers as :func:`whole_numbers` has them."""
    return np.array(rows, np.int64 if all(-SAFE < v < SAFE for row in rows for v in row) else object)


def valid(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id, vec (array<double>), label: rows whose vector can be compressed, of whatever length."""
    own = F.col(vec).cast("array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), own.alias("vec"), "label")
    return kept.where(F.col("vec").isNotNull() & (F.size("vec") > 0)).where(~F.coalesce(bad, F.lit(True)))


Books = list[list[list[int]]]  # by part, entry, place


def first_books(kept: DataFrame, parts: int, entries: int) -> Books:
    """The parts of the vectors of the least ids; at most ``entries`` rows come to the driver."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(1).collect()
    if not first:
        return []
    size = len(first[0]["vec"])
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    least = kept.where(F.size("vec") == size).orderBy(F.col("vec_id").asc_nulls_last(), "vec").limit(entries).collect()
    whole = whole_numbers([r["vec"] for r in least]).tolist()
    step = size // parts
    return [[row[p * step : (p + 1) * step] for row in whole] for p in range(parts)]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    vec = batch.column("vec")
    flat = vec.flatten().to_numpy(zero_copy_only=False)
    return whole_numbers(flat.reshape(len(vec), -1)) if len(vec) else np.zeros((0, 1), np.int64)


def _trees(books: Books) -> list[KdTree]:
    return [KdTree(numbers(book)) for book in books]


def refine(kept: DataFrame, books: Books) -> Books:
    """One round: parts to their nearest entries, entries to the floored means; unused ones stay."""
    spark = kept.sparkSession
    worker_path(spark)
    small_batches(spark)
    sent = spark.sparkContext.broadcast(_trees(books))
    step, entries = len(books[0][0]), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a task: (part, entry, place, digit, sum, parts added)."""
        lean()
        sums = np.zeros((len(books), entries, step), object)
        counts = np.zeros((len(books), entries), np.int64)
        for batch in batches:
            x = _rows(batch)
            for p, tree in enumerate(sent.value):
                own = x[:, p * step : (p + 1) * step]
                code, _ = tree.nearest(own)
                added = np.zeros((entries, step), own.dtype)
                np.add.at(added, code, own)
                sums[p] += added.astype(object)
                counts[p] += np.bincount(code, minlength=entries)
        out = []
        for p, e in zip(*np.nonzero(counts), strict=True):
            for k in range(step):
                left, digit = int(sums[p, e, k]), 0
                while digit == 0 or left not in (0, -1):
                    out.append((p, e, k, digit, left & ((1 << DIGIT) - 1), counts[p, e]))
                    left >>= DIGIT
                    digit += 1
                if left:  # a negative number ends in endless ones: minus one of the next digit
                    out.append((p, e, k, digit, -1, counts[p, e]))
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(map(int, c)), pa.int64()) for c in columns], ["part", "entry", "place", "digit", "total", "n"])

    partial = kept.select("vec").mapInArrow(run, "part bigint, entry bigint, place bigint, digit bigint, total bigint, n bigint")
    summed = partial.groupBy("part", "entry", "place", "digit").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    totals: dict = {}
    for r in summed.collect():  # parts x entries x places x digits: of the codebooks' size
        t = totals.setdefault((r.part, r.entry, r.place), [0, 0])
        t[0] += r.total << (DIGIT * r.digit)
        t[1] = max(t[1], r.n)  # of digit 0, which every sum has
    return [[[t[0] // t[1] if (t := totals.get((p, e, k))) else v for k, v in enumerate(entry)] for e, entry in enumerate(book)] for p, book in enumerate(books)]


def fit(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Books:
    """The codebooks after ``rounds`` rounds over all rows; none for an empty table."""
    books = first_books(kept, parts, entries)
    if books:
        kept = _of_length(kept, books)
        for _ in range(rounds):
            books = refine(kept, books)
    return books


def _of_length(kept: DataFrame, books: Books) -> DataFrame:
    return kept.where(F.size("vec") == len(books) * len(books[0][0]))


def encode(kept: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, code (binary, a byte for each part), error."""
    types = "vec_id bigint, label " + kept.schema["label"].dataType.simpleString()
    if not books:
        return kept.where("false").select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("bigint").alias("error"))
    sent = kept.sparkSession.sparkContext.broadcast(_trees(books))
    step = len(books[0][0])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _rows(batch)
        found = [tree.nearest(x[:, p * step : (p + 1) * step]) for p, tree in enumerate(sent.value)]
        codes = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
        errors = [min(sum(map(int, d)), MOST) for d in zip(*[d for _, d in found], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return map_batches(_of_length(kept, books).select("vec_id", "label", "vec"), run, f"{types}, code binary, error bigint")


def decode(codes: DataFrame, books: Books) -> DataFrame:
    """``codes`` with ``vec``: the vectors that the codes stand for, in the original scale."""
    book = F.array(*[F.array(*[F.array(*[F.lit(v / SCALE) for v in e]) for e in b]) for b in books]) if books else F.array().cast("array<array<array<double>>>")
    byte = lambda p: F.conv(F.substring(F.hex("code"), 2 * p + 1, 2), 16, 10).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(max(len(books) - 1, 0))), lambda p: F.get(F.get(book, p), byte(p)))
    return codes.withColumn("vec", F.flatten(parts))


def books_digest(books: Books) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256."""
    kept = valid(vectors)
    books = fit(kept)
    coded = settle(encode(kept, books), "vector-codes")
    total = F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit(MOST).cast("decimal(20,0)")).cast("bigint")
    # written: both sides of the join have sizes, so few labels are broadcast and many are shuffled, with AQE splitting a hot one
    labels = settle(coded.groupBy("label").agg(total.alias("label_error")), "label-errors").withColumnRenamed("label", "_label")
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows in SQL: all distances of every part to its codebook, in each round."""

    def nearest(k: int) -> str:
        square = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        return f"near{k} as (select p.row, p.part, any_value(p.x) as x, min({{'d': {square}, 'e': b.entry}}) as best from parts p join book{k} b on p.part = b.part group by p.row, p.part)"

    steps = []
    for k in range(rounds):
        steps.append(nearest(k))
        steps.append(
            f"""mean{k} as (select part, entry, list(m order by place) as x from (
  select part, entry, place, cast(floor(sum(v) / count(*)) as bigint) as m
  from (select part, best.e as entry, unnest(x) as v, generate_subscripts(x, 1) as place from near{k}) group by part, entry, place
) group by part, entry),
book{k + 1} as (select b.part, b.entry, coalesce(m.x, b.x) as x from book{k} b left join mean{k} m on b.part = m.part and b.entry = m.entry)"""
        )
    return f"""
with kept as (
  select row_number() over (order by vec_id nulls last, embedding) as row, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as (
  select row, p as part, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x from kept, range({parts}) r(p)
), book0 as (select part, row - 1 as entry, x from parts where row <= {entries}),
{", ".join(steps)},
{nearest(rounds)},
coded as (select row, string_agg(lpad(to_hex(best.e), 2, '0'), '' order by part) as code, cast(sum(best.d) as bigint) as error from near{rounds} group by row),
sha as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from book{rounds})
select vec_id, lower(code) as code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded join kept using (row), sha
"""


ORACLE = oracle()

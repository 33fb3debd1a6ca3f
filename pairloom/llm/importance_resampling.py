"""Importance resampling towards a target distribution, over hashed word n-grams.

Features of a text are its runs of one to three consecutive words, hashed to 10,000
buckets. A first pass counts the buckets of all documents and of all target texts:
every partition adds up ``np.bincount`` vectors and a ``treeReduce`` merges them, so
10,000 longs are all that leaves a partition. The logarithms of the two
distributions' ratio, as integers, are broadcast (80 KB, whatever the input), and a
second pass gathers them and sums each document with ``np.bincount`` weights. With
a Gumbel variable made from the id on top, the largest scores are a sample without
replacement; they are ranked by a range partitioning and the sizes of its parts, so
no task sorts all rows.

Defined results: a null text, an empty one and one without words have no feature and
weight 0. A null id counts as an empty string where it is hashed and comes last among
ties. Rows of one id and text are rows of their own, with one score and adjoining
ranks. An empty table of documents gives no row, an empty target a uniform one. Texts of
any length are hashed in blocks of words. Only doc_id and text are read; other columns are
carried where ``keep`` names them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import fields, lean, map_batches, small_batches
from pairloom.session import settle, worker_path

BUCKETS = 10_000
LONGEST = 3  # words of a feature
LEAST_WORDS = 20  # of a document that may be drawn
DRAWN_PCT = 5
SEED = "42"

#: Bytes that are no part of a word become blanks, capitals of ASCII small letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK = 1 << 20  # bytes of text that are words at once


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in blocks."""
    raw = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + BLOCK)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def buckets(text: str | None) -> tuple[int, np.ndarray]:
    """(words, the bucket of every feature). A checksum goes on from that of the run without its last word."""
    n, before, found = 0, [], []
    for block in word_blocks(text):
        n += len(block)
        words = before + block
        spaced = [b" " + w for w in words]
        runs = [list(map(crc32, words))]
        for k in range(1, LONGEST):
            runs.append(list(map(crc32, spaced[k:], runs[-1])))
        # runs of k + 1 words that end in this block
        new = [run[max(len(before) - k, 0) :] for k, run in enumerate(runs)]
        found.append(np.fromiter(chain(*new), np.int64, sum(map(len, new))) % BUCKETS)
        before = words[-(LONGEST - 1) :]
    return n, np.concatenate(found) if found else np.zeros(0, np.int64)


def bucket_counts(df: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    spark = df.sparkSession
    worker_path(spark)
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                total += np.bincount(buckets(text.as_py())[1], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = fields(df, "text").mapInArrow(run, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(BUCKETS, np.int64)
    # at most the root or the cube root of the partitions' number comes to the driver, 80 KB each
    return vectors.treeReduce(np.add, depth=2 if parts <= 1024 else 3)


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """1,000 times the logarithm of (share in the target / share in the documents), floored; counts plus one."""
    s_all, t_all = float(have.sum()) + BUCKETS, float(want.sum()) + BUCKETS
    pairs = zip(have.tolist(), want.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(((t + 1) * s_all) / ((s + 1) * t_all))) for s, t in pairs], np.int64)


def _gumbel(ident: int | None, seed: str) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = ("doc_id",), seed: str = SEED, names: tuple[str, str, str, str] = ("n_words", "n_features", "weight", "score")) -> DataFrame:
    """The columns ``keep`` and, under ``names``, words, features, weight and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").cast("bigint").alias("_own_id"), F.col("text").alias("_own_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [buckets(t.as_py()) for t in batch.column("_own_text")]
        sizes = np.array([len(b) for _, b in found], np.int64)
        row = np.repeat(np.arange(len(found)), sizes)
        every = np.concatenate([*[b for _, b in found], np.zeros(0, np.int64)])
        weights = np.bincount(row, weights=sent.value[every], minlength=len(found)).astype(np.int64)
        chance = np.array([_gumbel(i, seed) for i in batch.column("_own_id").to_pylist()], np.int64)
        made = [np.array([n for n, _ in found], np.int64), sizes, weights, weights + chance]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], *map(pa.array, made)], [*keep, *names])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in keep]).schema)
    return map_batches(kept, run, f"{types}, " + ", ".join(f"`{n}` bigint" for n in names))


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]


def ranks(scored: DataFrame, least_words: int = LEAST_WORDS, pct: int = DRAWN_PCT) -> DataFrame:
    """``scored`` (a written table) with ``rank``: 1, 2, 3... for the drawn ``pct`` percent of the rows of at least
    ``least_words`` words, else null. Ranges of the order are dealt to tasks, sorted there, and
    each row's rank is its place plus the sizes of the ranges before."""
    may = scored.where(F.col("n_words") >= least_words)
    take = pct * may.count() // 100
    place = F.monotonically_increasing_id()  # (partition, place in it)
    dealt = may.repartitionByRange(*_order()).sortWithinPartitions(*_order())
    dealt = settle(dealt.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND(2**33 - 1).alias("at")), "drawn-ranges")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("at") + 1
    drawn = dealt.join(F.broadcast(before), "part").select(*scored.columns, F.when(rank <= take, rank).alias("rank"))
    return drawn.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))


def model(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gains of the buckets, from all texts of both tables."""
    return gains(bucket_counts(docs), bucket_counts(target))


def resample(docs: DataFrame, target: DataFrame, least_words: int = LEAST_WORDS, pct: int = DRAWN_PCT, seed: str = SEED) -> DataFrame:
    """The drawn documents, with all their columns. Ranks are of narrow rows; texts are scored again and held
    against the last drawn row instead of being shuffled. Rows equal to that one in id and score come with it."""
    gain = model(docs, target)
    scored = settle(score(docs, gain, seed=seed), "resample-scores")
    last = ranks(scored, least_words, pct).where("rank is not null").orderBy(F.col("rank").desc()).limit(1).collect()
    names = tuple(f"_resample_{n}" for n in ("words", "features", "weight", "score"))
    again = score(docs, gain, tuple(docs.columns), seed, names)
    if not last:
        return again.where("false").select(*docs.columns)
    value, ident = last[0]["score"], last[0]["doc_id"]
    tie = F.lit(True) if ident is None else F.coalesce(F.col("doc_id") <= ident, F.lit(False))
    over = (F.col(names[3]) > value) | ((F.col(names[3]) == value) & tie)
    return again.where((F.col(names[0]) >= least_words) & over).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document."""
    slim = fields(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    scored = settle(score(slim, model(slim, target)), "resample-scores")
    return ranks(scored).select("doc_id", "n_features", "weight", "score", "rank")

"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams (1 to 3 characters,
words padded by a blank) in order of frequency. A document's own list is
compared with each profile by out-of-place distance: the sum over the document's
n-grams of the difference of the two ranks, or of the profile's length where the
profile lacks the n-gram. The nearest profile wins.

Defined results: null text, empty text and text without a letter give ``und``
and score 0. Ties between languages go to the name that sorts first, ties
between n-grams to the smaller code points. Training skips rows with a null text
or language. Without any training row every document is ``und``. Repeated rows count
as often as they are there. A text of any length is counted whole, in about 40
bytes of memory a character. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.llm.common import fields, map_batches

PROFILE_SIZE = 300
WORDS = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
SHIFT = 21  # bits of a code point: three fit a long
SALT = 32


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as longs, with their counts."""
    padded = " " + " ".join(WORDS.findall(text.lower())) + " "
    one = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    two = one[:-1] << SHIFT | one[1:]
    three = two[:-1] << SHIFT | one[2:]
    keys = np.concatenate([one[one != 32], two, three])
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent keys, by count descending, then key."""
    if len(keys) > 4 * size:  # keep everything that ties with the last one
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:size]]


def learn_profiles(labelled: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, rank) from rows of (text, lang), over all of them. Tasks count their batches,
    Spark adds the counts up; the ranking is done in salted parts before the final one, so that no
    task holds all n-grams of a language."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts: dict[str, list] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            if LETTER.search(said := text.as_py()):
                parts.setdefault(lang.as_py(), []).append(grams(said))
        langs, keys, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lang, pairs in parts.items():
            every, where = np.unique(np.concatenate([k for k, _ in pairs]), return_inverse=True)
            langs += [lang] * len(every)
            keys.append(every)
            counts.append(np.bincount(where, np.concatenate([c for _, c in pairs])).astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(counts))], ["lang", "gram", "n"])

    usable = fields(labelled, "text", "lang").where("text is not null and lang is not null")
    totals = map_batches(usable, run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = [F.col("n").desc(), F.col("gram")]
    part = Window.partitionBy("lang", F.pmod("gram", F.lit(SALT))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    few = totals.withColumn("place", F.row_number().over(part)).where(F.col("place") <= size).drop("place")
    return few.withColumn("rank", F.row_number().over(whole) - 1).where(F.col("rank") < size).select("lang", "gram", "rank")


def predict(docs: DataFrame, profiles: list[tuple[str, int, int]], size: int = PROFILE_SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score (1 - distance / greatest possible distance).
    ``profiles`` are rows of :func:`learn_profiles`: ``size`` for each language at most."""
    langs = sorted({p[0] for p in profiles})
    known = np.array(sorted({p[1] for p in profiles}), np.int64)
    ranks = np.full((len(langs), len(known)), -1, np.int64)
    for lang, gram, rank in profiles:
        ranks[langs.index(lang), np.searchsorted(known, gram)] = rank

    def one(text: str | None) -> tuple[str, float]:
        if not text or not langs or not LETTER.search(text):
            return "und", 0.0
        top = ranked(*grams(text), size)
        at = np.searchsorted(known, top)
        there = known[np.minimum(at, len(known) - 1)] == top
        found = np.where(there, ranks[:, np.minimum(at, len(known) - 1)], -1)
        away = np.where(found >= 0, np.abs(found - np.arange(len(top))), size).sum(axis=1)
        best = int(np.argmin(away))
        return langs[best], 1.0 - float(away[best]) / (size * len(top))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [one(t.as_py()) for t in batch.column("text")]
        columns = [batch.column(c) for c in keep] + [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    kept = fields(docs, *keep, "text")
    schema = T.StructType([kept.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_batches(kept, run, schema)


def identify(docs: DataFrame, training: Column, size: int = PROFILE_SIZE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the rows where ``training`` holds, predict every row."""
    learned = learn_profiles(docs.where(training), size)
    # size rows for each language: bounded by the languages, not by the documents
    return predict(docs, [tuple(r) for r in learned.collect()], size, keep)


def identify_held_out(docs: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id as text, modulo 4, is 2), lang_pred, score; training uses
    the others. A null id is held out of nothing."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    slim = docs.select("doc_id", "text", "lang", out.alias("held_out"))
    return identify(slim, ~F.col("held_out"), keep=("doc_id", "held_out"))

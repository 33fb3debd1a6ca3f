"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import Scratch, worker_path


@lru_cache(maxsize=1)
def lean() -> None:
    """Once in a Python worker, which lives for many tasks: memory of freed arrays goes back. glibc would
    keep it after the first large ones, and so would Arrow's own pool; with several workers beside an
    executor's heap this was hundreds of megabytes."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 4 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):
        pass  # another C library


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over Arrow batches, without a shuffle. Batches are bounded by rows and bytes
    (:func:`small_batches`), so memory does not grow with a partition."""
    worker_path(df.sparkSession)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            made = fn(batch)
            if isinstance(made, pa.RecordBatch):
                yield made
            else:
                yield from made

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """At most a thousand rows and 16 MB in an Arrow batch, unless the session asks for less: several
    workers share an executor's memory, and every batch is there as Python objects, too."""
    for name, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{name}"
        have = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < have <= most:
            spark.conf.set(key, str(most))


def row_key(*columns: str) -> tuple[Column, Column]:
    """A 128-bit key of a row's content as two longs. Twins (rows equal in these columns) share
    it and so share every result; rows that only share an id do not."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))


def split_twins(keyed: DataFrame, a: str, b: str, twins: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key (a, b) isn't in ``twins``, one row for each key that is, with ``copies``, their
    number). Copies meet as partial aggregates, so a key that a third of the rows have stays
    divisible. Which of the twins' rows stands for them is open: they share id and text."""
    if twins is None:
        return keyed, None
    own = F.struct(*[F.col(f"`{c}`") for c in keyed.columns])
    one = keyed.join(twins, [a, b], "left_semi").groupBy(a, b).agg(F.first(own).alias("row"), F.count("*").alias("copies"))
    return keyed.join(twins, [a, b], "left_anti"), one.select("row", "copies")


def twin_keys(keys: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame | None:
    """The keys that several rows of ``keys`` (a, b) have; None if there are none."""
    found = scratch.settle(keys.groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1").select(a, b), "twins")
    return None if found.isEmpty() else found


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column of a table (whatever its case) has them."""
    have, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def fields(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: what else a table carries cannot clash with working columns."""
    return df.select(*[F.col(n) for n in names])


def packed(df: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, ``size`` and ``blob``: texts compressed for a shuffle (null stays null)."""
    kept = df.select(*keep, "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = pa.Codec("zstd", compression_level=6)
        raw = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
        blobs = [None if r is None else codec.compress(r, asbytes=True) for r in raw]
        sizes = [None if r is None else len(r) for r in raw]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], [*keep, "size", "blob"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name in keep)
    return map_batches(kept, run, f"{types}, size bigint, blob binary")


def unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The UTF-8 texts of a batch with ``size`` and ``blob``, one at a time; null as empty."""
    for size, blob in zip(batch.column("size"), batch.column("blob"), strict=True):
        yield pa.decompress(blob.as_buffer(), size.as_py(), "zstd", asbytes=True) if blob.is_valid and size.as_py() else b""


BITMAP_ROWS = 1024


def bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of 2^25 bits (4 MB, however many keys there are) of a column of hashes, for
    :func:`in_bitmap`. Spark sets the bits; 1,024 rows of 4 KB at most come to the driver."""
    place = F.pmod(key, F.lit(BITMAP_ROWS)).cast("int")
    bit = F.pmod(F.shiftrightunsigned(key, 10), F.lit(32768)).cast("int")
    out = np.zeros((BITMAP_ROWS, 4096), np.uint8)
    for row in keys.groupBy(place.alias("place")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect():
        out[row.place] = np.frombuffer(row.bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be among the keys: all that are, few others while the keys are far fewer than the bits."""
    h = h.view(np.uint64)
    bit = (h >> np.uint64(10)).astype(np.int64) & 32767
    return (bits[(h & np.uint64(BITMAP_ROWS - 1)).astype(np.int64), bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0

"""Calls to a service with a window of them in flight, answers kept as they come (EXT1, EXT2).

Every task holds ``in_flight`` calls open at once and writes its answers to a log of its own in the shared folder,
``flush`` at a time, as they arrive. A task that is lost and started again reads what its earlier attempts
wrote and asks only what is open; so does a later run over the same log. The service stays outside: any callable
from a prompt to a text, which must be one on every worker.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.joins import not_done
from pairloom.session import worker_path
from pairloom.streaming.external import call_with_retries

ANSWER = pa.schema([("key", pa.string()), ("response", pa.string()), ("ok", pa.bool_())])


class Pace:
    """At most ``per_second`` calls a second of one task, started evenly; None: no limit."""

    def __init__(self, per_second: float | None):
        self.gap, self.next = 1 / per_second if per_second else 0.0, 0.0

    def wait(self) -> None:
        now = time.monotonic()
        if self.next > now:
            time.sleep(self.next - now)
        self.next = max(now, self.next) + self.gap


def window(items: Iterator[tuple[str, str]], work: Callable[[str], str | None], in_flight: int, pace: Pace) -> Iterator[tuple[str, str | None]]:
    """(key, answer) in the order in which answers come; at most ``in_flight`` items are taken and not answered."""
    with ThreadPoolExecutor(in_flight) as pool:
        open_: dict[Future, str] = {}

        def take() -> bool:
            item = next(items, None)
            if item is not None:
                pace.wait()
                open_[pool.submit(work, item[1])] = item[0]
            return item is not None

        while len(open_) < in_flight and take():
            pass
        while open_:
            done, _ = wait(open_, return_when=FIRST_COMPLETED)
            for future in done:
                yield open_.pop(future), future.result()
                take()


class Log:
    """Answers of one task under ``folder``, in files that appear whole."""

    def __init__(self, folder: str, flush: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.flush, self.held = flush, []

    def keys(self) -> set[str]:
        """What is answered already."""
        if self.fs.get_file_info(self.folder).type != pafs.FileType.Directory:
            return set()
        files = [i.path for i in self.fs.get_file_info(pafs.FileSelector(self.folder)) if i.path.endswith(".parquet")]
        return {k for f in files for k in pq.read_table(f, columns=["key"], filesystem=self.fs).column(0).to_pylist()}

    def add(self, key: str, response: str | None) -> None:
        self.held.append((key, response, response is not None))
        if len(self.held) >= self.flush:
            self.close()

    def close(self) -> None:
        if not self.held:
            return
        self.fs.create_dir(self.folder, recursive=True)
        name = uuid.uuid4().hex
        table = pa.table([pa.array(c, t.type) for c, t in zip(zip(*self.held, strict=True), ANSWER, strict=True)], schema=ANSWER)
        pq.write_table(table, f"{self.folder}/.{name}.tmp", filesystem=self.fs)
        self.fs.move(f"{self.folder}/.{name}.tmp", f"{self.folder}/{name}.parquet")
        self.held = []


def answers(spark: SparkSession, path: str) -> DataFrame:
    """(key, response, ok) of a log: one row for each key, an answer before a failure."""
    fs, folder = pafs.FileSystem.from_uri(path)
    schema = "key string, response string, ok boolean"
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return rows.groupBy("key").agg(F.max_by("response", "ok").alias("response"), F.max("ok").alias("ok"))


def ask_into(df: DataFrame, key: str, prompt: str, path: str, call: Callable[[str], str], in_flight: int = 16, flush: int = 32, retries: int = 3, pause: float = 1.0, per_second: float | None = None, tasks: int | None = None) -> DataFrame:
    """Ask the service for every key (a string, one row each) that the log under ``path`` has no answer for, and return
    the log. A failed call (after ``retries``, with doubling pauses) is kept as not ok, and asked again by the next
    run. NULL prompts have no call and no answer. ``tasks`` times ``in_flight`` calls are open at once."""
    spark = df.sparkSession
    worker_path(spark)
    done = answers(spark, path).where("ok").select("key")
    todo = not_done(df.where(F.col(prompt).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(prompt).alias("prompt")), done, ["key"])
    run = uuid.uuid4().hex
    # by key, so that a task that is started again has the same rows
    dealt = todo.repartition(tasks or spark.sparkContext.defaultParallelism, "key")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        log = Log(f"{path}/run={run}/task={TaskContext.get().partitionId():05d}", flush)
        had, n, pace = log.keys(), 0, Pace(per_second)

        def items() -> Iterator[tuple[str, str]]:
            for batch in batches:
                for k, p in zip(batch.column("key").to_pylist(), batch.column("prompt").to_pylist(), strict=True):
                    if k not in had:
                        yield k, p

        try:
            for k, response in window(items(), lambda p: call_with_retries(call, p, retries, pause * random.uniform(0.5, 1.5)), in_flight, pace):
                log.add(k, response)
                n += 1
        finally:
            log.close()  # what has come is kept even if the task fails
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["asked"])

    dealt.mapInArrow(each, "asked bigint").agg(F.sum("asked")).collect()  # one number
    return answers(spark, path)

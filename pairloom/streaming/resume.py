"""Resumable state: anti-joins on finished keys, appends that count once they are committed, a cache of
chunks, shards with a manifest, and a file stream with a checkpoint."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.operators.joins import not_done
from pairloom.session import spread
from pairloom.sources.writers import list_names, read_text, write_text


def commit(df: DataFrame, path: str, note: dict | None = None) -> str:
    """Append ``df`` as a batch: its files first, then its marker. A batch without a marker, of a run that
    was lost, is as if it had never been."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/batch={name}")
    write_text(df.sparkSession, f"{path}/_done/{name}.json", json.dumps(note or {}, sort_keys=True))
    return name


def committed(spark: SparkSession, path: str) -> dict[str, dict]:
    """Names and notes of the batches that count."""
    return {n.removesuffix(".json"): json.loads(read_text(spark, f"{path}/_done/{n}")) for n in list_names(spark, f"{path}/_done") if n.endswith(".json")}


def finished(spark: SparkSession, path: str, schema: str, keys: list[str] | None = None) -> DataFrame:
    """What has been committed so far; an empty table before the first batch. With ``keys`` one row for
    each: two runs at the same time may both have done one."""
    names = sorted(committed(spark, path))
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", path).parquet(*[f"{path}/batch={n}" for n in names]).drop("batch")
    return rows.dropDuplicates(keys) if keys else rows


def resume(spark: SparkSession, todo: DataFrame, path: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> int:
    """STM1 / STM3 / JN10: do what isn't done and commit it; returns how many keys are done then."""
    schema = ", ".join(f"`{c}` {todo.schema[c].dataType.simpleString()}" for c in keys)
    commit(work(not_done(todo, finished(spark, path, schema), keys)), path)
    return finished(spark, path, schema, keys).count()


def append_once(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """STM5: append rows whose key isn't there yet; of new rows with one key, one."""
    schema = ", ".join(f"`{c}` {new.schema[c].dataType.simpleString()}" for c in keys)
    commit(not_done(new.dropDuplicates(keys), finished(spark, path, schema), keys), path)


def quarantine(rows: DataFrame, corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """STM2: (good rows, corrupt rows), instead of failing on a damaged file."""
    return rows.where(F.col(corrupt).isNull()).drop(corrupt), rows.where(F.col(corrupt).isNotNull()).select(corrupt)


def covers(cached: list[str], wanted: list[str]) -> bool:
    """STM4: whether a cache of scopes can serve a request."""
    return set(wanted) <= set(cached)


class ChunkCache:
    """STM4: chunks of results, each with the scopes it holds and the number of its rows in an index; a
    request is served by the chunks that cover its scopes, or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, df: DataFrame, scopes: list[str]) -> None:
        commit(df, self.root, {"scopes": sorted(scopes), "schema": df.schema.json()})

    def index(self) -> DataFrame:
        """(chunk, scopes) of every chunk."""
        rows = [(n, note["scopes"]) for n, note in sorted(committed(self.spark, self.root).items())]
        return self.spark.createDataFrame(rows, "chunk string, scopes array<string>")

    def get(self, scopes: list[str]) -> DataFrame | None:
        """The rows of the chunks that have every scope asked for; None if there is no such chunk."""
        names = [n for n, note in sorted(committed(self.spark, self.root).items()) if covers(note["scopes"], scopes)]
        if not names:
            return None
        return self.spark.read.option("basePath", self.root).parquet(*[f"{self.root}/batch={n}" for n in names]).drop("batch")


def stream_files(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], keys: list[str]) -> StreamingQuery:
    """STM1 as a stream: new files of a folder, worked on batch by batch. A batch that is repeated after a
    failure writes to the same folder again, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch.dropDuplicates(keys)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Counts and sums of events in time windows, late ones dropped after the watermark; for streams and
    tables alike."""
    counted = events.withWatermark("ts", late) if events.isStreaming else events
    return counted.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def write_shards(df: DataFrame, root: str, rows_per_shard: int, key: str) -> DataFrame:
    """STM6: rows in files of bounded length, and a manifest of which keys each file holds. Both are new
    folders, and a pointer that is written last makes them current: a failure in between leaves the
    old shards with their old manifest. Returns the manifest (file, n, first, last). A table whose scan has fewer
    tasks than there are cores is spread over them if it fills a shard for each: to open a file costs more than its rows do."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    cores = spark.sparkContext.defaultParallelism
    if df.limit(cores * rows_per_shard).count() == cores * rows_per_shard:
        df = spread(df)
    df.write.option("maxRecordsPerFile", rows_per_shard).parquet(f"{root}/{name}/shards")
    back = spark.read.parquet(f"{root}/{name}/shards").select(key, F.col("_metadata.file_name").alias("file"))
    back.groupBy("file").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).write.parquet(f"{root}/{name}/manifest")
    write_text(spark, f"{root}/CURRENT", name)
    return spark.read.parquet(f"{root}/{name}/manifest")


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """STM6: the current shards."""
    return spark.read.parquet(f"{root}/{read_text(spark, f'{root}/CURRENT')}/shards")

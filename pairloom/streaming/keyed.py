"""A stream that gives each key once, over restarts: its state remembers the keys that are finished."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocks_state(spark: SparkSession):
    """State that may outgrow memory: RocksDB's store for the queries started within."""
    had = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, had) if had is not None else spark.conf.unset(PROVIDER)


def unseen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """STM1: of a stream, each key's first row; rows of a key that the state knows are left out. The state grows with
    the keys, on the executors that own them, and comes back from the query's checkpoint."""
    return stream.dropDuplicates(keys)


def stream_once(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], keys: list[str], files: int = 1000) -> StreamingQuery:
    """STM1 / STM3: the new files of a folder, ``files`` in a batch, each key worked on once however often it comes
    and however often the query restarts. A batch that failed runs again whole: its folder in the sink is
    overwritten, and the state of its keys is that of the batch before. Ends when no file is left."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    with rocks_state(spark):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        return unseen(stream, keys).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

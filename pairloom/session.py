"""Session factory, table loading and shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(app: str = "pairloom", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every query relies on: UTC, AQE, skew-join handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where a scan has fewer tasks (one small file);
    a table of many files is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one JVM, so that a local folder is a shared one."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``; only where that is unset and the session is
    of one process (tests, one machine) a local default takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not one_process(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/pairloom-checkpoints"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/pairloom-{label}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever store holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Within, the shuffle files of an action go when it ends. Its results are written out, so
    nothing reads them again."""
    had = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, had) if had is not None else spark.conf.unset(FREED)


def settle(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, so that a
    lost executor costs only the running stage, gives both sides of a later join
    exchanges of their own, which AQE can split when a key is hot, and frees the shuffle files."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    with freed_shuffles(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_path = path
    if (own := _settled.get()) is not None:
        own.append(path)
    return back


_settled: ContextVar[list[str] | None] = ContextVar("settled", default=None)


@contextmanager
def swept(spark: SparkSession):
    """Within, the tables that operators settle go in the end: for work whose result has been written. Only those
    of the caller's own context: queries of other threads keep theirs."""
    token = _settled.set(paths := [])
    try:
        yield
    finally:
        _settled.reset(token)
        release(spark, *paths)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete settled tables that no later step reads."""
    for path in paths:
        drop_path(spark, path)


def settled_path(df: DataFrame) -> str:
    """The folder of a table that :func:`settle` returned."""
    return df._settled_path


class Scratch:
    """Settled tables that are deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        out = settle(df, label)
        self.paths.append(settled_path(out))
        return out

    def clear(self) -> None:
        release(self.spark, *self.paths)
        self.paths = []


_shipped: set[str] = set()


def worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package: from its folder where they run on the driver's machine,
    else from an archive that Spark sends to every executor, once for an application."""
    root = os.path.dirname(os.path.abspath(__file__))
    if one_process(spark):
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if os.path.dirname(root) not in paths:
            env["PYTHONPATH"] = os.pathsep.join([os.path.dirname(root), *paths])
        return
    if spark.sparkContext.applicationId in _shipped:
        return
    archive = os.path.join(tempfile.mkdtemp(), "pairloom.zip")  # on the driver; Spark's file server sends it
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(full := os.path.join(folder, name), os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)

"""Sinks. Spark's committer publishes a job's files all together or not at all; the pointers and manifests
here are written under a temporary name and renamed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> None:
    """SNK1 / SNK3: without some columns, the priority ones first, the rest by name; nested values as
    JSON."""
    rest = sorted(c for c in df.columns if c not in first and c not in drop)
    chosen = [c for c in first if c in df.columns and c not in drop] + rest
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, nested) else F.col(c) for c in chosen]
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = (), rows_per_file: int | None = None) -> None:
    """SNK2 / SNK5 / SNK8: optionally partitioned, files of bounded length."""
    writer = df.write.mode("overwrite")
    writer = writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """SNK4: NaN and infinities, which JSON lacks, become NULL."""
    clean = [F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema]
    df.select(*clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def grouped_json(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """SNK12: one row per class with its entries as a JSON array. For exports people read; an array holds
    a class, so large classes belong into :func:`write_parquet` by class."""
    return df.groupBy(group).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("entries"))


def subset(df: DataFrame, where: Column, columns: list[str]) -> DataFrame:
    """SNK11"""
    return df.where(where).select(*columns)


def confusion_of_best(df: DataFrame, layer: str, score: str, truth: str, guess: str, classes: list) -> DataFrame:
    """SNK13: the confusion matrix of the layer with the best score. One row broadcasts."""
    best = df.agg(F.max_by(layer, F.struct(F.col(score), (-F.col(layer)).alias("n"))).alias("_best"))
    rows = df.crossJoin(F.broadcast(best)).where(F.col(layer) == F.col("_best"))
    return rows.groupBy(truth).pivot(guess, classes).count().na.fill(0)


def wide(df: DataFrame, keys: list[str], layer: str, layers: list[int], metrics: list[str]) -> DataFrame:
    """ARR11 / D19: L{nn}_metric columns, for sinks only."""
    columns = [F.first(F.when(F.col(layer) == n, F.col(m)), ignorenulls=True).alias(f"L{n:02d}_{m}") for n in layers for m in metrics]
    return df.groupBy(*keys).agg(*columns)


def report(df: DataFrame, section: str) -> DataFrame:
    """SNK10: a table as (section, key, value) rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in df.columns]))
    return df.select(F.lit(section).alias("section"), pairs.alias("p")).select("section", "p.*")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def write_text(spark: SparkSession, path: str, content: str | bytes) -> None:
    """SNK6: a small file, under a temporary name and then renamed."""
    fs, target, jvm = _fs(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex}")
    out = fs.create(temp, True)
    out.write(bytearray(content.encode() if isinstance(content, str) else content))
    out.close()
    fs.delete(target, False)
    if not fs.rename(temp, target):
        raise OSError(f"cannot rename to {path}")


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, folder, _ = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, target, _ = _fs(spark, path)
    if not fs.exists(target):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


class Versions:
    """SNK7: a table kept in versions with a pointer to the current one and the one before; reading falls
    back when the current version is damaged."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self) -> list[str]:
        said = read_text(self.spark, f"{self.root}/CURRENT")
        return json.loads(said) if said else []

    def write(self, df: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        write_text(self.spark, f"{self.root}/CURRENT", json.dumps([name, *self._pointer()[:1]]))
        return name

    def read(self) -> DataFrame | None:
        for name in self._pointer():
            try:
                df = self.spark.read.parquet(f"{self.root}/{name}")
                df.limit(1).count()
                return df
            except Exception as error:  # noqa: BLE001  any damage counts; the older version is tried
                self.damaged = (name, str(error)[:200])
        return None


def write_experiment(root: str, family: str, experiment: str, tables: dict[str, DataFrame], metadata: dict) -> None:
    """SNK9: a folder per experiment and family: its tables (aggregate, per_pair, per_layer, ...) and
    metadata."""
    spark = next(iter(tables.values())).sparkSession
    base = f"{root.rstrip('/')}/family={family}/experiment={experiment}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    write_text(spark, f"{base}/metadata.json", json.dumps(metadata, sort_keys=True, default=str))

"""Sources. Every reader yields a DataFrame with columns pruned and filters pushed by the format."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.nested import variants_from_json

RECORD = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("dataset_index", T.IntegerType()),
    T.StructField("task_type", T.StringType()),
    T.StructField("original", T.StructType([
        T.StructField("question", T.StringType()),
        T.StructField("options", T.MapType(T.StringType(), T.StringType())),
        T.StructField("answer", T.StringType()),
        T.StructField("answer_idx", T.StringType()),
    ])),
    T.StructField("counterfactuals", T.StringType()),
])


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """SRC1 / SRC3 / ARR2: nested records of one or several JSON files, no deduplication; ``variants`` from
    either layout, ``file_idx`` and ``pos`` as the order for last-wins rules. The file's name and order
    tell ``file_idx``, never the task."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, path in enumerate(paths):  # a handful of files, each a distributed scan
        raw = spark.read.schema(RECORD).option("multiLine", True).json(path)
        part = raw.withColumns({"file_idx": F.lit(i), "pos": F.monotonically_increasing_id()})
        out = part if out is None else out.unionByName(part)
    variants = F.get_json_object("counterfactuals", "$.variants")
    return out.withColumn("variants", variants_from_json(variants))


def records_of(spark: SparkSession, path: str, record: str) -> DataFrame:
    """SRC2: a JSON document that is a list of records, or an object of them; anything else is an
    error. ``record`` is the DDL of one."""
    whole = spark.read.text(path, wholetext=True)
    first = F.left(F.ltrim("value"), F.lit(1))
    listed = F.from_json("value", f"array<{record}>")
    keyed = F.map_values(F.from_json("value", f"map<string,{record}>"))
    rows = F.when(first == "[", listed).when(first == "{", keyed).otherwise(F.raise_error(F.lit("neither a list nor an object of records")))
    return whole.select(F.explode(rows).alias("r")).select("r.*")


def read_split(spark: SparkSession, path: str, split: str, name: str) -> DataFrame:
    """SRC4: a split whose ``idx`` was stored with it; the id is name_split_idx."""
    return spark.read.parquet(path).where(F.col("split") == split).withColumn("question_id", F.concat_ws("_", F.lit(name), "split", F.col("idx").cast("string")))


def read_csv(spark: SparkSession, path: str, schema: str, split: str | None = None, sep: str = ",") -> DataFrame:
    """SRC5: with a schema, since inference would read everything twice; an optional split."""
    df = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return df.where(F.col("split") == split) if split else df


def read_task_folders(spark: SparkSession, root: str, schema: str, file: str = "train.tsv") -> DataFrame:
    """SRC6: one TSV file per folder, the folder's name as task_name."""
    df = read_csv(spark, f"{root.rstrip('/')}/*/{file}", schema, sep="\t")
    return df.withColumn("task_name", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """SRC7"""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def read_jsonl(spark: SparkSession, path: str, schema: str, successful: bool = False) -> DataFrame:
    """SRC8: JSON lines; with ``successful`` only those whose ``success`` holds."""
    df = spark.read.schema(schema).json(path)
    return df.where("success") if successful else df


def read_npz(spark: SparkSession, path: str, values: str, axes: list[str]) -> DataFrame:
    """SRC9 / SRC10: an NPZ array with named axes as a long table: one column per axis (its name, else its
    index), ``value`` for one-dimensional cells or ``vec`` over the last axis. Archives are small by
    their nature; each is read by one task from its bytes, so any store will do."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = np.load(io.BytesIO(content.as_py()), allow_pickle=False)
                cube = found[values]
                outer = cube.shape[:-1]
                names = [found[a].astype(str) if a in found else np.arange(n).astype(str) for a, n in zip(axes, outer, strict=False)]
                index = np.indices(outer).reshape(len(outer), -1)
                columns = [pa.array(names[k][index[k]]) for k in range(len(outer))]
                vec = pa.array(list(cube.reshape(-1, cube.shape[-1]).astype(np.float64)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*columns, vec], [*axes[: len(outer)], "vec"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{a} string" for a in axes[:-1]) + ", vec array<double>")


class ShardedStore:
    """SRC11 / SRC14: a keyed store in Parquet, partitioned by ``kind``; look-ups are joins, single keys are
    pushed down to the files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def results(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/results").where(F.col("kind") == kind).drop("kind")

    def get(self, kind: str, key: str) -> DataFrame:
        return self.results(kind).where(F.col("key") == key)

    def pairs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/pair_metadata")

    def shards(self) -> DataFrame:
        """The files and how many keys each holds."""
        rows = self.spark.read.parquet(f"{self.root}/results").select("key", F.col("_metadata.file_path").alias("file"))
        return rows.groupBy("file").agg(F.count("*").alias("n_keys"))


def read_fields(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """SRC12: fields taken out of whole text files by regular expressions (group 1)."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", *[F.nullif(F.regexp_extract("value", p, 1), F.lit("")).alias(n) for n, p in patterns.items()])


def read_schema(spark: SparkSession, path: str) -> dict:
    """SRC13: a JSON Schema document, for operators.quality."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_index(spark: SparkSession, path: str, integers: list[str]) -> DataFrame:
    """SRC15: a CSV of strings, some columns as integers where they are."""
    df = spark.read.option("header", True).csv(path)
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as int)") for c in integers})


def stacked(frames: dict[str, DataFrame], item_text: dict[str, str]) -> DataFrame:
    """PRJ32 / SET9: domains of different columns as one table with domain and item_text."""
    out = None
    for domain, df in frames.items():
        part = df.withColumns({"domain": F.lit(domain), "item_text": F.col(item_text[domain])})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

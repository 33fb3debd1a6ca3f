"""Queries over arrays and the store of vectors, written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans.registry import query
from pairloom.session import shared_path, table
from pairloom.sources import array_source


def _vectors(spark, sf_dir) -> DataFrame:
    """The embeddings as originals, their doubles as edited ones."""
    e = table(spark, sf_dir, "embeddings").select(F.format_string("q%08d", "vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"))
    sides = F.explode(F.array(F.struct(F.lit("original").alias("kind"), F.col("v").alias("vec")), F.struct(F.lit("edited").alias("kind"), F.transform("v", lambda x: x * 2).alias("vec"))))
    return e.select("key", sides.alias("s")).select("s.kind", "key", "s.vec")


@query(
    "SRC11 SRC14 SNK6 SNK8",
    "select 'q' || lpad(cast(vec_id as varchar), 8, '0') as key, round(2 * embedding[1]::double - embedding[1]::double, 6) as moved, cast(len(embedding) as integer) as width from embeddings",
)
def stored_pairs(spark, sf_dir):
    """Both kinds of every key from the store, joined."""
    path = shared_path(spark, "vectors")
    array_source.write_vectors(_vectors(spark, sf_dir), path, rows_per_file=200)
    a, b = (array_source.read_vectors(spark, path, [k]).select("key", F.col("vec").alias(k)) for k in ("original", "edited"))
    return a.join(b, "key").select("key", F.round(F.get("edited", F.lit(0)) - F.get("original", F.lit(0)), 6).alias("moved"), F.size("edited").alias("width"))


@query("SRC11", "select 'q' || lpad(cast(vec_id as varchar), 8, '0') as key, round(2 * embedding[3]::double, 6) as third, 1 as tasks from embeddings where vec_id = (select max(vec_id) from embeddings)")
def stored_key(spark, sf_dir):
    """One key of one kind: one file is read for it."""
    path = shared_path(spark, "vectors")
    array_source.write_vectors(_vectors(spark, sf_dir), path, rows_per_file=50)
    last = table(spark, sf_dir, "embeddings").agg(F.format_string("q%08d", F.max("vec_id")).alias("k")).first().k
    found = array_source.read_vectors(spark, path, ["edited"], [last])
    return found.select("key", F.round(F.get("vec", F.lit(2)), 6).alias("third"), F.lit(found.rdd.getNumPartitions()).alias("tasks"))


@query("SNK6 SNK7", "select label % 3 as part, count(*) as n, round(sum(embedding[1]::double) * 3, 5) as first from embeddings group by 1")
def stored_versions(spark, sf_dir):
    """A second version takes the first one's place; a third, whose task fails, takes none's."""
    from pyspark.errors import PySparkException

    path = shared_path(spark, "versions")
    rows = table(spark, sf_dir, "embeddings").select((F.col("label") % 3).cast("string").alias("kind"), F.format_string("q%08d", "vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vec"))
    array_source.write_vectors(rows, path)
    array_source.write_vectors(rows.withColumn("vec", F.transform("vec", lambda x: x * 3)), path)
    try:
        array_source.write_vectors(rows.withColumn("vec", F.when(F.col("key") > "q00000100", F.col("vec"))), path)
    except PySparkException as error:
        if "must not be null" not in str(error):
            raise
    back = array_source.read_vectors(spark, path)
    return back.groupBy(F.col("kind").cast("int").alias("part")).agg(F.count("*").alias("n"), F.round(F.sum(F.get("vec", F.lit(0))), 5).alias("first"))


@query("SRC9 SRC10 SNK5", "select label, count(*) as n, round(sum(embedding[1]::double), 5) as first, round(sum(embedding[64]::double), 5) as last from embeddings group by 1")
def sliced_arrays(spark, sf_dir):
    """The store's archives as plain arrays, in slices of sixteen rows, with their labels by a join."""
    path = shared_path(spark, "arrays")
    array_source.write_vectors(_vectors(spark, sf_dir).where("kind = 'original'"), path, rows_per_file=100)
    rows = array_source.read_arrays(spark, path, "vec", ["key"], taskBytes=16 * 64 * 8)
    ids = table(spark, sf_dir, "embeddings").select(F.format_string("q%08d", "vec_id").alias("key"), "label")
    return rows.join(ids, "key").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(F.get("vec", F.lit(0))), 5).alias("first"), F.round(F.sum(F.get("vec", F.lit(63))), 5).alias("last"))

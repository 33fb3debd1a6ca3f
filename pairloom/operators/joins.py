"""Joins of originals, edited results and annotation passes. Spark picks the join; nothing is hinted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """T8: the last row of each key, before a join that would otherwise fan out. By aggregation, which
    combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return top.select(*keys, "_last.*")


def pair_join(pairs: DataFrame, original: DataFrame, edited: DataFrame, orig_key: str, pair_key: str) -> DataFrame:
    """JN1: pairs with both results; those that lack one are left out."""
    return pairs.join(original, orig_key).join(edited, pair_key)


def optional_join(pairs: DataFrame, extra: DataFrame, key: str, flag: str) -> DataFrame:
    """JN2: extra results where there are any, and a flag."""
    return pairs.join(extra.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def fallback_join(df: DataFrame, first: DataFrame, second: DataFrame, first_key: str, second_key: str, value: str, default: Column | None = None) -> DataFrame:
    """JN3/4: the value by the first key, else by the second, else the default."""
    a = first.select(first_key, F.col(value).alias("_a"))
    b = second.select(second_key, F.col(value).alias("_b"))
    out = df.join(a, first_key, "left").join(b, second_key, "left")
    parts = [F.col("_a"), F.col("_b")] + ([default] if default is not None else [])
    return out.withColumn(value, F.coalesce(*parts)).drop("_a", "_b")


def in_all(df: DataFrame, key: str, part: str, n: int | None = None, parts: list | None = None) -> DataFrame:
    """JN5 / JN15: keys that occur with all n parts (or with every one of ``parts``)."""
    rows = df.where(F.col(part).isin(parts)) if parts is not None else df
    return rows.groupBy(key).agg(F.count_distinct(part).alias("_n")).where(F.col("_n") == (len(parts) if parts is not None else n)).select(key)


def paired_means(df: DataFrame, key: str, focal: Column, control: Column, value: Column) -> DataFrame:
    """JN6: per key the mean of focal and of control rows and their difference; keys with both only."""
    means = df.groupBy(key).agg(F.avg(F.when(focal, value)).alias("focal"), F.avg(F.when(control, value)).alias("control"))
    return means.where("focal is not null and control is not null").withColumn("difference", F.col("focal") - F.col("control"))


def matched_first(controls: DataFrame, focal: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """JN8 / SMP6: n controls, those whose key is among the focal keys first; ``matched`` tells which."""
    keys = focal.select(key).distinct().withColumn("_m", F.lit(True))
    marked = controls.join(keys, key, "left").withColumn("matched", F.coalesce("_m", F.lit(False))).drop("_m")
    return marked.orderBy(F.col("matched").desc(), *order).limit(n)


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """JN9 / JN10 / STM3: what isn't among the finished keys yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def rebuild_missing(keys: DataFrame, known: DataFrame, source: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """JN11: rows rebuilt from the source for keys without metadata, and the keys the source lacks."""
    missing = keys.select(key).distinct().join(known.select(key), key, "left_anti")
    return missing.join(source, key), missing.join(source.select(key), key, "left_anti")


def with_default(df: DataFrame, dimension: DataFrame, key: str, default: str = "UNKNOWN") -> DataFrame:
    """JN12: string fields of a dimension, with a default for keys it lacks."""
    fields = [f for f in dimension.columns if f != key]
    return df.join(dimension, key, "left").withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit(default)) for f in fields})


def pairs_within(df: DataFrame, group: str, ident: str, value: str, most: int) -> DataFrame:
    """JN13: all pairs i < j of the first ``most`` rows of each group, in hash order: a sample whose size
    bounds the pairs, which is the operator's meaning."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.md5(F.concat(F.col(ident).cast("string"), F.lit(":0"))), ident))
    few = df.withColumn("_r", rank).where(F.col("_r") <= most)
    a = few.select(F.col(group), F.col(ident).alias("a"), F.col(value).alias("va"), F.col("_r").alias("_ra"))
    b = few.select(F.col(group), F.col(ident).alias("b"), F.col(value).alias("vb"), F.col("_r").alias("_rb"))
    return a.join(b, group).where("_ra < _rb").drop("_ra", "_rb")


def label_matrix(aggregates: DataFrame, label: str, value: str) -> DataFrame:
    """JN14: every ordered pair of different labels. The rows are group aggregates, one per label; an
    equi-join on a constant bucket keeps it a plain join."""
    a = aggregates.select(F.lit(1).alias("_k"), F.col(label).alias("a"), F.col(value).alias("va"))
    b = aggregates.select(F.lit(1).alias("_k"), F.col(label).alias("b"), F.col(value).alias("vb"))
    return a.join(b, "_k").where("a <> b").drop("_k")

"""Ranks, z-scores, binning, top-k. Ranks within a group that only keep k rows are group-limited by Spark
before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.counts import quantiles


def z_score(x: Column, group: list[str]) -> Column:
    """WIN1: population deviation; 0 where that is 0 or unknown."""
    w = Window.partitionBy(*group)
    std = F.stddev_pop(x).over(w)
    return F.when(std.isNull() | F.isnan(std) | (std == 0), 0.0).otherwise(F.try_divide(x - F.avg(x).over(w), std))


def candidate_heads(df: DataFrame, group: str, head: str, edit: str, entropy: str, behavior: str) -> DataFrame:
    """WIN1-2: means per (group, head), their z-scores in the group, and z_edit + 0.5 z_entropy +
    0.75 z_behavior. The NULL group is kept (T13)."""
    means = df.groupBy(group, head).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in (edit, entropy, behavior)])
    out = means.withColumns({"z_edit": z_score(F.col(f"mean_{edit}"), [group]), "z_entropy": z_score(F.col(f"mean_{entropy}"), [group]), "z_behavior": z_score(F.col(f"mean_{behavior}"), [group])})
    return out.withColumn("candidate_score", F.col("z_edit") + 0.5 * F.col("z_entropy") + 0.75 * F.col("z_behavior"))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """WIN3 / WIN5 / WIN11 / SRT2: the first k of each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def rank_heads(df: DataFrame, score: str, k: int, group: list[str] | None = None) -> DataFrame:
    """WIN4: score, layer, head, all descending (T14)."""
    return top_k(df, group or [], [F.col(score).desc(), F.col("layer").desc(), F.col("head").desc()], k)


def prefixes(df: DataFrame, group: list[str], rank: str, value: str) -> DataFrame:
    """WIN6: for each rank the list of values up to it."""
    w = Window.partitionBy(*group).orderBy(rank).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("prefix", F.collect_list(value).over(w))


def cumulative(df: DataFrame, group: list[str], order: str, value: str, name: str = "cumulative") -> DataFrame:
    """WIN13: running sum."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def first_present(value: Column, order: Column) -> Column:
    """WIN8, an aggregate: the first value that isn't NULL."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def label_pairs(df: DataFrame, group: str, label: str, least: int, most: int) -> DataFrame:
    """WIN9: pairs of a group's labels with at least ``least`` rows, most frequent first; at most ``most``
    pairs of a group."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(group).orderBy(F.col("n").desc(), F.col(label))
    ranked = counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + 1)
    a = ranked.select(group, F.col(label).alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"))
    b = ranked.select(group, F.col(label).alias("b"), F.col("n").alias("nb"), F.col("r").alias("rb"))
    pairs = a.join(b, group).where("ra < rb")
    return top_k(pairs, [group], [F.col("ra"), F.col("rb")], most, "pair_rank").drop("ra", "rb")


def percentile_bins(df: DataFrame, x: str, n_bins: int, values: dict[str, Column]) -> DataFrame:
    """WIN10: bins between percentile edges, both sides closed and widened by 1e-10, so that a value on an
    inner edge counts in two bins (T15). The edges are one row; the rows meet them without a shuffle."""
    edges = quantiles(df, [], x, [i / n_bins for i in range(n_bins + 1)], "edges")
    bins = edges.select(F.posexplode(F.slice("edges", 1, n_bins)).alias("bin", "low"), "edges").select("bin", "low", F.get("edges", F.col("bin") + 1).alias("high"))
    inside = df.join(F.broadcast(bins), (F.col(x) >= F.col("low") - 1e-10) & (F.col(x) <= F.col("high") + 1e-10))  # n_bins rows
    return inside.groupBy("bin").agg(F.count("*").alias("n"), *[F.avg(c).alias(name) for name, c in values.items()])

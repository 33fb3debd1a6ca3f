"""Set operators: last-wins union, distinct unions, overlaps of top sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """SET1: the value of the last file that has an id, at the place where the id came first. Each frame
    needs ``pos``, its row order; rows without an id are left out."""
    tagged = [f.withColumn("file_idx", F.lit(i)) for i, f in enumerate(frames)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged).where(F.col(key).isNotNull())
    return last_wins_rows(every, key, ["file_idx", "pos"])


def last_wins_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """SET1 for one table: ``first_place`` is the least order of the id."""
    rest = [c for c in df.columns if c not in (key, *order)]
    place = F.struct(*order)
    top = df.groupBy(key).agg(F.max_by(F.struct(*rest), place).alias("_v"), F.min(place).alias("first_place"))
    return top.select(key, "_v.*", "first_place")


def union_sorted(values: Column) -> Column:
    """SET2, an aggregate: the distinct elements of all arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(values))))


def distinct_spans(spans: Column) -> Column:
    """SET3: the first of each (span, role), order kept."""
    return F.array_distinct(F.transform(spans, lambda s: F.struct(s["span"].alias("span"), s["role"].alias("role"))))


def exclusive_memberships(df: DataFrame, element: list[str], group: str, groups: list) -> DataFrame:
    """SET7: elements by the exact set of groups they belong to, as a bitmap: (bitmap, n)."""
    power = F.lit(0)
    for i, g in enumerate(groups):
        power = F.when(F.col(group) == g, F.lit(2**i)).otherwise(power)
    return df.groupBy(*element).agg(F.bit_or(power.cast("bigint")).alias("bitmap")).groupBy("bitmap").agg(F.count("*").alias("n"))


def common_to_all(arrays: list[Column]) -> Column:
    """SET6"""
    return reduce(F.array_intersect, arrays)


def only_in(one: Column, others: list[Column]) -> Column:
    """SET6: of one set, what no other has."""
    return reduce(F.array_except, others, one)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """SET9 / SET12: tables of different columns, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def id_numbers(df: DataFrame, column: str) -> DataFrame:
    """SET11: the distinct integers behind the last underscore of ids."""
    number = F.expr(f"try_cast(substring_index(`{column}`, '_', -1) as bigint)")
    return df.select(number.alias("idx")).where("idx is not null").distinct()

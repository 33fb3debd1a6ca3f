"""Order statistics from counts of values: running sums over ranges of values, and exact quantiles.

No task sorts a group and no buffer holds its values: rows become counts per (group, value) first,
ranges of these are dealt to tasks, and each range needs only the sums of those before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.session import settle


def same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys, NULL equal to NULL; the keys once, from the left."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)  # one row
    renamed = right.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    return left.join(renamed, on, how).drop(*[f"_k_{i}" for i in range(len(keys))])


def running(counts: DataFrame, group: list[str], order: str, sums: list[str]) -> DataFrame:
    """``counts`` (one row for each group and value of ``order``) with ``<c>_before`` for each of ``sums``: its sum
    over the smaller values of the group. The ranges are written, so both reads see the same ones."""
    keys = [*group, order]
    parts = settle(counts.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "running")
    totals = parts.groupBy("_p", *group).agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])  # a row for each range, and for each group inside
    w = Window.partitionBy(*group).orderBy("_p") if group else Window.orderBy("_p")
    base = totals.select("_p", *group, *[(F.sum(f"_t_{c}").over(w) - F.col(f"_t_{c}")).alias(f"_b_{c}") for c in sums])
    within = Window.partitionBy("_p", *group).orderBy(order)
    own = parts.select("*", *[(F.sum(c).over(within) - F.col(c)).alias(f"_w_{c}") for c in sums])
    both = same(own, base, ["_p", *group])
    return both.select(*counts.columns, *[(F.col(f"_b_{c}") + F.col(f"_w_{c}")).alias(f"{c}_before") for c in sums])


def quantiles(df: DataFrame, group: list[str], x: str, probs: list[float], name: str = "q", upper: bool = False, times: str | None = None) -> DataFrame:
    """AGG6 / AGG14 / WIN10: (group, n, ``name``): exact quantiles with linear interpolation, as an array in the order
    of ``probs``; with ``upper`` its last is the element at n // 2 of the sorted values (T12). NULLs don't count, and
    groups without a value have no row. ``times`` is how often a row counts."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*group, x).agg((F.sum(times) if times else F.count("*")).alias("_n"))
    placed = running(counts, group, x, ["_n"])
    n = placed.groupBy(*group).agg(F.sum("_n").alias("n"))
    place = F.array(*[(F.col("n") - 1) * F.lit(float(p)) for p in probs], *([F.floor(F.col("n") / 2).cast("double")] if upper else []))
    first, last = F.col("_n_before"), F.col("_n_before") + F.col("_n") - 1
    # of each probability the value at its lower and at its upper place, whichever this row holds
    at = F.transform(place, lambda h: F.struct(h.alias("h"), F.floor(h).alias("low"), F.ceil(h).alias("high")))
    rows = same(placed, n, group)
    hits = rows.withColumn("_h", F.filter(F.transform(at, lambda a, i: F.struct(i.alias("i"), (a["low"].between(first, last)).alias("low"), (a["high"].between(first, last)).alias("high"), (a["h"] - a["low"]).alias("f"))), lambda a: a["low"] | a["high"]))
    long = hits.where(F.size("_h") > 0).select(*group, "n", F.col(x).cast("double").alias("_x"), F.explode("_h").alias("_h"))
    low, high = F.max(F.when(F.col("_h.low"), F.col("_x"))), F.max(F.when(F.col("_h.high"), F.col("_x")))
    each = long.groupBy(*group, "n", F.col("_h.i").alias("_i")).agg((low + F.max("_h.f") * (high - low)).alias("_q"))
    packed = each.groupBy(*group, "n").agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_a"))  # as many as probabilities
    return packed.select(*group, "n", F.transform("_a", lambda a: a["_q"]).alias(name))


def auroc(df: DataFrame, group: list[str], score: str, positive: Column) -> DataFrame:
    """ST13: area under the curve per group, ties counting a half: for each score, its positives against the
    negatives below it. NULL where a class is missing; rows without score or class don't count."""
    rows = df.withColumn("_y", positive).where(F.col(score).isNotNull() & F.col("_y").isNotNull())
    counts = rows.groupBy(*group, score).agg(F.count_if("_y").alias("_pos"), F.count_if(~F.col("_y")).alias("_neg"))
    placed = running(counts, group, score, ["_neg"])
    above = F.sum(F.col("_pos") * (F.col("_neg_before") + F.col("_neg") / 2.0))
    return placed.groupBy(*group).agg(F.try_divide(above, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auroc"), F.sum("_pos").alias("n_positive"), F.sum("_neg").alias("n_negative"))

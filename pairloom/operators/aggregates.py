"""Grouped statistics. All combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.counts import quantiles, same

STATS = "n n_valid mean std median p25 p75 frac_positive frac_negative".split()


def frequency(df: DataFrame, column: str) -> DataFrame:
    """AGG1: value, n, percent of all rows (NULL is a value)."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG2: field, value, n over many columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def element_frequency(df: DataFrame, column: str) -> DataFrame:
    """AGG3: element, n of the exploded arrays."""
    return df.select(F.explode(column).alias("element")).groupBy("element").agg(F.count("*").alias("n"))


def rate(condition: Column) -> Column:
    """AGG4 / AGG15: part of the rows where it holds; NULL doesn't count."""
    return F.avg(condition.cast("int"))


def co_occurrence(df: DataFrame, flags: list[str]) -> DataFrame:
    """AGG5: how many rows have how many of the flags."""
    total = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return df.groupBy(total.alias("n_flags")).agg(F.count("*").alias("n"))


def summary(df: DataFrame, group: list[str], x: str, upper: bool = False) -> DataFrame:
    """AGG6 / AGG14: (group, n, n_valid, mean, std (population), median, p25, p75, frac_positive, frac_negative); all but
    the counts are NULL without valid values. Quantiles come from counts of values (:mod:`pairloom.operators.counts`);
    with ``upper`` there is ``upper_median`` (T12), too."""
    v = F.col(x)
    sums = df.groupBy(*group).agg(
        F.count("*").alias("n"), F.count(v).alias("n_valid"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.avg((v > 0).cast("int")).alias("frac_positive"), F.avg((v < 0).cast("int")).alias("frac_negative"),
    )
    out = same(sums, quantiles(df, group, x, [0.25, 0.5, 0.75], "_q", upper).drop("n"), group, "left")
    names = ["p25", "median", "p75"] + ["upper_median"] * upper
    return out.select(*group, "n", "n_valid", "mean", "std", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(names)], "frac_positive", "frac_negative")


def by_strata(df: DataFrame, strata: dict[str, Column], metrics: dict[str, Column], rates: dict[str, Column] | None = None) -> DataFrame:
    """AGG16-18: statistics of metrics in strata that overlap: every row is copied to each stratum it
    meets, and to each metric; one aggregation then does them all. (stratum, metric, statistics)."""
    into = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(s)) for s, c in strata.items()]))
    every = {m: c.cast("double") for m, c in metrics.items()} | {f"{m}_rate": c.cast("int").cast("double") for m, c in (rates or {}).items()}
    values = F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("x")) for m, c in every.items()])
    rows = df.select(F.explode(into).alias("stratum"), values.alias("values")).select("stratum", F.explode("values").alias("v"))
    return summary(rows.select("stratum", "v.metric", "v.x"), ["stratum", "metric"], "x")


def flip_table(flip: Column, orig: Column, edited: Column) -> list[Column]:
    """AGG21: outcomes of a change of answers and the rates that follow from them."""
    def count(c: Column) -> Column:
        return F.count_if(c)

    n = F.greatest(F.count("*"), F.lit(1))
    harm, good = count(flip & orig & ~edited), count(flip & ~orig & edited)
    return [
        F.count("*").alias("n"),
        count(flip).alias("n_flips"),
        harm.alias("correct_to_wrong"),
        good.alias("wrong_to_correct"),
        count(flip & orig & edited).alias("correct_to_correct_diff"),
        count(flip & ~orig & ~edited).alias("wrong_to_wrong_diff"),
        count(~flip).alias("no_flip"),
        count(~flip & orig).alias("no_flip_correct"),
        count(~flip & ~orig).alias("no_flip_wrong"),
        (count(flip) / n).alias("flip_rate"),
        (harm / n).alias("harm_rate"),
        (good / n).alias("benefit_rate"),
        ((harm - good) / n).alias("net_harm"),
    ]


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """AGG7/8/22/29: counts with a fixed order of columns, 0 where there are none."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """AGG10: the most frequent value of a key, the one seen first on ties; its share, unanimity and the
    number of distinct values. NULLs don't vote."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"), F.min(order).alias("seen"))
    top = F.max_by(F.struct(F.col(value).alias("majority"), F.col("c")), F.struct(F.col("c"), (-F.col("seen")).alias("s")))
    out = counts.groupBy(*keys).agg(top.alias("top"), F.sum("c").alias("n"), F.count("*").alias("n_unique"))
    return out.select(*keys, "top.majority", (F.col("top.c") / F.col("n")).alias("majority_frac"), (F.col("n_unique") == 1).alias("unanimous"), "n_unique")


def agreement(df: DataFrame, flags: list[str]) -> DataFrame:
    """AGG11: rate of agreement for each field."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("int").alias("agree")) for f in flags]))
    return df.select(pairs.alias("p")).groupBy("p.field").agg(F.avg("p.agree").alias("rate"))


def curve(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """AGG13: mean and standard error (population deviation over the root of n)."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), (F.stddev_pop(x) / F.sqrt(F.count(x))).alias("sem"), F.count(x).alias("n"))


def cell_moments(df: DataFrame, keys: list[str], x: Column) -> DataFrame:
    """AGG20: mean, deviation and part above zero of each cell."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.avg((x > 0).cast("int")).alias("frac_positive"), F.count(x).alias("n"))


def centroid(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """AGG24: the mean vector of a group, dimension by dimension: sums of (key, place) combine before
    the shuffle; the array of one vector's length is put together at the end."""
    long = df.select(*keys, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    means = long.groupBy(*keys, "pos").agg(F.avg("x").alias("m"), F.count("x").alias("n"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p"), F.max("n").alias("n"))
    return packed.select(*keys, F.transform("p", lambda p: p["m"]).alias("centroid"), "n")


def peak(df: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """AGG26: where the value is largest, the lower place on ties; the mean over valid places."""
    top = F.max_by(F.col(place), F.struct(F.col(value), (-F.col(place)).alias("p")))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(top.alias("peak"), F.max(value).alias("peak_value"), F.avg(value).alias("mean"))


def variation(df: DataFrame, keys: list[str], group: str, x: Column) -> DataFrame:
    """AGG27: deviation over mean (plus 1e-10) of the group means of each key."""
    means = df.groupBy(*keys, group).agg(F.avg(x).alias("m"))
    return means.groupBy(*keys).agg((F.stddev_pop("m") / (F.avg("m") + 1e-10)).alias("cv"), F.count("*").alias("n_groups"))


def share_of_full(df: DataFrame, keys: list[str], early: Column, full: Column, value: str) -> DataFrame:
    """AGG30: 100 * effect of the early condition / full effect; NULL when that is 0."""
    return df.groupBy(*keys).agg((100.0 * F.try_divide(F.avg(F.when(early, F.col(value))), F.avg(F.when(full, F.col(value))))).alias("early_share_pct"))


def presence(df: DataFrame, columns: list[str]) -> DataFrame:
    """AGG35: rows that have a value, by field."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_present")) for c in columns])).alias("p")).select("p.*")

"""Tests and effect sizes. What has a closed form is columns; resampling runs by group in Arrow batches
with a fixed seed."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.session import settle


def cohens_d(x: Column, first: Column, second: Column) -> Column:
    """ST2, an aggregate: difference of means over the pooled deviation; 0 where it is degenerate."""
    a, b = F.when(first, x), F.when(second, x)
    na, nb = F.count(a), F.count(b)
    pooled = F.sqrt(((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b)) / F.nullif(na + nb - 2, F.lit(0)))
    return F.coalesce(F.when((na >= 2) & (nb >= 2) & (pooled >= 1e-10), (F.avg(a) - F.avg(b)) / pooled), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's correlation, an aggregate; NULL where either side doesn't vary (Spark's own raises an
    error there in ANSI mode)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def ranked(df: DataFrame, column: str, name: str, group: list[str] | None = None, ties: str | None = None) -> DataFrame:
    """Average ranks from 1 under ``name`` (``ties``: how many rows share the value), by group. No task sorts
    a group: :func:`value_ranks`, and a join back. The ranks are settled, so that their size is known when the join is
    planned: those of a column of few values are broadcast, and the rows are not shuffled; otherwise AQE can split the
    sides at a common value."""
    group = group or []
    keys = [*group, column]
    ranks = settle(value_ranks(df.groupBy(*keys).agg(F.count("*").alias("_n")), column, name, group), "ranks")
    ranks = ranks.select(*keys, name, *([F.col("_n").alias(ties)] if ties else []))
    return _same(df, ranks, keys)


def value_ranks(counts: DataFrame, column: str, name: str, group: list[str]) -> DataFrame:
    """Average ranks from 1 under ``name`` of values with their counts ``_n``, by running sums over range-partitioned
    values. These are settled with their partition's number, which the sums of partitions and those within must share."""
    keys = [*group, column]
    parts = settle(counts.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "parts")
    sums = parts.groupBy("_p", *group).agg(F.sum("_n").alias("_s"))  # a row for each partition, and for each group inside
    before = Window.partitionBy(*group).orderBy("_p") if group else Window.orderBy("_p")
    base = sums.select("_p", *group, (F.sum("_s").over(before) - F.col("_s")).alias("_base"))
    within = F.sum("_n").over(Window.partitionBy("_p", *group).orderBy(column))
    ranks = _same(parts.withColumn("_c", within), base, ["_p", *group])
    return ranks.select(*counts.columns, (F.col("_base") + F.col("_c") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(name))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join on equal keys, NULL equal to NULL; the keys once."""
    renamed = right.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    joined = left.join(renamed, on)
    return joined.drop(*[f"_k_{i}" for i in range(len(keys))])


def global_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks over a whole table."""
    return ranked(df, column, name)


def spearman(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """ST5: rho and n per group, over rows with both values."""
    group = group or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    both = ranked(ranked(rows, x, "_rx", group), y, "_ry", group)
    return both.groupBy(*group).agg(correlation(F.col("_rx"), F.col("_ry")).alias("rho"), F.count("*").alias("n"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str, group: list[str] | None = None) -> DataFrame:
    """ST4: correlation of x and y without z, its t value; p by :func:`t_two_sided`."""
    group = group or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*[F.col(g) for g in group], F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(z).alias("_z"))
    rows = ranked(ranked(rows, "_x", "_rx", group), "_z", "_rz", group)
    # y's ranks meet the other two's sums by value of y, so the rows are shuffled once, and summed before
    sums = [F.sum(c).alias(n) for n, c in {"_sx": F.col("_rx"), "_sz": F.col("_rz"), "_sxz": F.col("_rx") * F.col("_rz"), "_sxx": F.col("_rx") ** 2, "_szz": F.col("_rz") ** 2}.items()]
    values = rows.groupBy(*group, "_y").agg(F.count("*").alias("_n"), *sums)
    values = value_ranks(values, "_y", "_ry", group)
    ry = F.col("_ry")
    total = values.groupBy(*group).agg(
        F.sum("_n").alias("n"), F.sum(ry * F.col("_sx")).alias("_xy"), F.sum(ry * F.col("_sz")).alias("_yz"), F.sum(ry * ry * F.col("_n")).alias("_yy"),
        *[F.sum(c).alias(c) for c in ("_sxz", "_sxx", "_szz")],
    )
    middle = F.col("n") * ((F.col("n") + 1) / 2.0) ** 2  # average ranks have this mean, whatever the ties
    of = lambda a, b, c: F.try_divide(F.col(a) - middle, F.nullif(F.sqrt((F.col(b) - middle) * (F.col(c) - middle)), F.lit(0.0)))
    r = total.select(*group, of("_xy", "_sxx", "_yy").alias("rxy"), of("_sxz", "_sxx", "_szz").alias("rxz"), of("_yz", "_yy", "_szz").alias("ryz"), "n")
    floor = F.lit(1e-10)
    rho = (F.col("rxy") - F.col("rxz") * F.col("ryz")) / (F.sqrt(F.greatest(1 - F.col("rxz") ** 2, floor)) * F.sqrt(F.greatest(1 - F.col("ryz") ** 2, floor)))
    out = r.withColumn("rho", rho)
    return out.withColumn("t", F.col("rho") * F.sqrt(F.greatest(F.col("n") - 3, F.lit(1))) / F.sqrt(F.greatest(1 - F.col("rho") ** 2, floor)))


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t, by the incomplete beta function's continued fraction."""

    def one(v, n):
        if v is None or math.isnan(v):
            return None
        x = n / (n + v * v)
        return beta_inc(n / 2, 0.5, x)

    return pd.Series([one(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, h = 1.0, 1 - (a + b) * x / (a + 1), 0.0
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal distribution."""
    return pd.Series([None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)) for v in z], dtype="float64")


def mann_whitney(df: DataFrame, x: str, first: Column, group: list[str] | None = None) -> DataFrame:
    """ST6: U of the first sample and its z, with tie and continuity correction (upper side)."""
    group = group or []
    rows = ranked(df.where(F.col(x).isNotNull() & first.isNotNull()).withColumn("_f", first.cast("int")), x, "_r", group, "_t").withColumn("_t", F.col("_t").cast("double"))
    s = rows.groupBy(*group).agg(
        F.sum(F.col("_r") * F.col("_f")).alias("r1"), F.sum("_f").cast("double").alias("n1"), F.sum(1 - F.col("_f")).cast("double").alias("n2"), F.sum(F.col("_t") ** 2 - 1).alias("ties")
    )
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    var = F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    return s.select(*group, u.alias("u"), ((u - F.col("n1") * F.col("n2") / 2 - 0.5) / F.sqrt(var)).alias("z"), F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"))


def wilcoxon(df: DataFrame, d: str, group: list[str] | None = None) -> DataFrame:
    """ST7: W+ of signed ranks and its z with tie correction; zeros are left out. Five rows at least are
    sensible, which the caller sees in n."""
    group = group or []
    rows = df.where(F.col(d).isNotNull() & (F.col(d) != 0)).withColumn("_a", F.abs(F.col(d)))
    rows = ranked(rows, "_a", "_r", group, "_t").withColumn("_t", F.col("_t").cast("double"))
    s = rows.groupBy(*group).agg(F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("w"), F.count("*").alias("n"), F.sum(F.col("_t") ** 2 - 1).alias("ties"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    return s.select(*group, "w", "n", ((F.col("w") - n * (n + 1) / 4) / F.sqrt(var)).alias("z"))


def point_biserial(flag: Column, x: Column) -> Column:
    """ST8, an aggregate."""
    return correlation(flag.cast("double"), x)


ITEMS = 4096  # of a correlation matrix; its square comes to the driver


def pearson_matrix(df: DataFrame, key: str, item: str, value: str) -> DataFrame:
    """ST9: correlation of every two items over the keys they share, as (a, b, r, n). Items are heads or
    dimensions, ``ITEMS`` at most. Each key's values become a row of a matrix (repeated items by their mean), and
    tasks add up products of its rows, of the values about their item's mean: a key meets no other, and no join
    is needed. r is over keys where both have a value, NULL where either doesn't vary; n counts the keys that have both
    items, with a value or without."""
    from pairloom.plans.probe_sweep import tree_sums

    means = df.groupBy(item).agg(F.avg(value).alias("m"), F.avg(F.abs(value)).alias("size")).orderBy(item).limit(ITEMS + 1).collect()
    if len(means) > ITEMS:
        raise ValueError(f"a correlation matrix of over {ITEMS} items")
    place = {r[0]: i for i, r in enumerate(means)}
    mean = np.array([r.m or 0.0 for r in means], float)
    m = len(means)
    rows = df.groupBy(key).agg(F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).cast("double").alias("v"))).alias("row"))  # a key's items

    def make(batch) -> dict[str, np.ndarray]:
        total, seen, have = (np.zeros((len(batch), m)) for _ in range(3))
        for k, row in enumerate(batch.column("row").to_pylist()):
            for cell in row:
                i = place[cell["i"]]
                seen[k, i] = 1
                if cell["v"] is not None:
                    have[k, i] += 1
                    total[k, i] += cell["v"] - mean[i]
        x, valid = total / np.maximum(have, 1), (have > 0).astype(float)
        return {"": np.stack([seen.T @ seen, valid.T @ valid, x.T @ valid, x.T @ x, (x * x).T @ valid]).ravel()}

    sums = tree_sums(rows.select("row"), make).get("", np.zeros(5 * m * m)).reshape(5, m, m)
    both, n, s, xy, xx = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        var = xx - s * s / n
        r = (xy - s * s.T / n) / np.sqrt(var * var.T)
    size = np.array([r_.size or 0.0 for r_ in means], float)
    flat = ~(var > n * (1e-12 * size[:, None]) ** 2)
    r = np.where(flat | flat.T, np.nan, r)
    out = [(means[a][0], means[b][0], None if np.isnan(r[a, b]) else float(r[a, b]), int(both[a, b])) for a in range(m) for b in range(a, m) if both[a, b]]
    kind = df.schema[item].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"a {kind}, b {kind}, r double, n bigint")


def bootstrap(df: DataFrame, group: str, x: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """ST1: percentile interval of the mean at 95 %. Poisson counts stand for resampling (T20). Rows of one
    value are drawn together (a sum of Poisson counts is one), seeded by group and value, and only sums
    leave a task: a group is never gathered, and however the rows are split the interval is the same."""
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(x).cast("double").alias("x")).where("x is not null")
    sums = _poisson_sums(rows.groupBy("g", "x").agg(F.count("*").alias("c")), draws, seed)
    means = sums.groupBy("g", "b").agg((F.sum("s") / F.sum("w")).alias("m"))
    tails = means.groupBy("g").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    seen = rows.groupBy("g").agg(F.avg("x").alias("mean"))
    return _same(seen, tails, ["g"]).select(F.col("g").cast(kind).alias(group), "mean", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"))


def _poisson_sums(values: DataFrame, draws: int, seed: int) -> DataFrame:
    """(g, b, s, w): for each draw b the sums of the drawn values and of their counts, of a task's values."""
    import pyarrow as pa

    schema = pa.schema([("g", pa.string()), ("b", pa.int64()), ("s", pa.float64()), ("w", pa.float64())])

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for g, v, c in zip(*[batch.column(n).to_pylist() for n in ("g", "x", "c")], strict=True):
                w = np.random.default_rng([seed, zlib.crc32(repr((g, v)).encode())]).poisson(c, draws)
                s = sums.setdefault(g, np.zeros((2, draws)))
                s += np.stack([v * w, w])
        for g, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * draws, pa.string()), pa.array(np.arange(draws)), pa.array(s[0]), pa.array(s[1])], schema=schema)

    return values.mapInArrow(run, "g string, b bigint, s double, w double")


VALUES = 4096  # distinct values of a block of the permutation test


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """How many of ``good`` a draw of ``sample`` out of ``good + bad`` holds. numpy's own stops at 1e9: above
    it every row is taken with the chance sample / all, and what is too few or too many of that is drawn
    in the same way from the rest or from the taken, which is the same distribution."""
    good, bad, sample = (np.array(v, np.int64) for v in np.broadcast_arrays(good, bad, sample))
    out, small = np.zeros(sample.shape, np.int64), good + bad < 10**9
    out[small] = rng.hypergeometric(good[small], bad[small], sample[small])
    if (big := ~small & (sample > 0)).any():
        g, b, n = good[big], bad[big], sample[big]
        share = n / (g + b)
        x, y = rng.binomial(g, share), rng.binomial(b, share)
        lack = n - x - y
        more, less = np.maximum(lack, 0), np.maximum(-lack, 0)
        x = x + hypergeometric(rng, g - x, b - y, more) - hypergeometric(rng, x, y, less)
        out[big] = x
    return out


def permutation(df: DataFrame, group: str, x: str, first: Column, draws: int = 5000, seed: int = 42) -> DataFrame:
    """ST3: two-sided p of a difference of means over all rows. A permutation only decides how many of the
    rows of each value fall to the first sample: hypergeometric counts, drawn for blocks of
    ``VALUES`` values or so by the sizes of the blocks and then inside each block, so rows are never
    gathered. Without rows on both sides difference and p are NaN."""
    kind = df.schema[group].dataType.simpleString()
    rows = df.where(F.col(x).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(x).cast("double").alias("x"), F.coalesce(first, F.lit(False)).cast("int").alias("f"))
    values = rows.groupBy("g", "x").agg(F.count("*").alias("c"), F.sum("f").alias("k"))
    n, k = F.sum("c"), F.sum("k")
    s, s1 = F.sum(F.col("x") * F.col("c")), F.sum(F.col("x") * F.col("k"))
    totals = values.groupBy("g").agg(n.alias("n"), k.alias("n1"), s.alias("s"), s1.alias("s1"), F.sum(F.abs("x") * F.col("c")).alias("size"), F.ceil(F.count("*") / VALUES).alias("blocks"))
    dealt = values.join(totals.select(F.col("g").alias("tg"), "blocks"), F.col("g").eqNullSafe(F.col("tg"))).select("g", F.pmod(F.xxhash64("x"), "blocks").alias("block"), "x", "c", "k")
    sizes = dealt.groupBy("g", "block").agg(n.alias("n"), k.alias("k"))

    def start(g, *more: int) -> np.random.Generator:
        return np.random.default_rng([seed, zlib.crc32(repr(g).encode()), *more])

    def allot(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        left, want, rng, taken = int(frame["n"].sum()), np.full(draws, frame["k"].sum(), np.int64), start(frame["g"].iloc[0]), []
        for size in frame["n"]:
            left -= size
            taken.append(hypergeometric(rng, size, left, want))
            want = want - taken[-1]
        return pd.DataFrame({"g": frame["g"], "block": frame["block"], "taken": [t.tobytes() for t in taken]})

    def draw(inside: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        inside = inside.sort_values("x")
        g, block, want = share["g"].iloc[0], int(share["block"].iloc[0]), np.frombuffer(share["taken"].iloc[0], np.int64)
        left, rng, sums = int(inside["c"].sum()), start(g, block), np.zeros(draws)
        for value, count in zip(inside["x"], inside["c"], strict=True):
            left -= count
            got = hypergeometric(rng, count, left, want)
            sums += value * got
            want = want - got
        return pd.DataFrame({"g": [g] * draws, "b": np.arange(draws), "s": sums})

    shares = sizes.groupBy("g").applyInPandas(allot, "g string, block bigint, taken binary")
    drawn = dealt.groupBy("g", "block").cogroup(shares.groupBy("g", "block")).applyInPandas(draw, "g string, b bigint, s double")
    sums = drawn.groupBy("g", "b").agg(F.sum("s").alias("drawn"))
    n2 = F.col("n") - F.col("n1")
    seen = totals.where((F.col("n1") > 0) & (n2 > 0)).select(F.col("g").alias("tg"), "n", "n1", "s", "size", (F.col("s1") / F.col("n1") - (F.col("s") - F.col("s1")) / n2).alias("difference"))
    both = sums.join(seen, F.col("g").eqNullSafe(F.col("tg")))
    moved = F.abs(F.col("drawn") / F.col("n1") - (F.col("s") - F.col("drawn")) / n2)
    # sums in another order differ in their last places
    hit = moved >= F.abs("difference") - F.col("size") / F.col("n") * 1e-12
    tests = both.groupBy("g").agg(F.first("difference").alias("difference"), F.avg(hit.cast("int")).alias("p"))
    nan = F.lit(float("nan"))
    out = totals.select(F.col("g").alias("tg"), "n").join(tests, F.col("g").eqNullSafe(F.col("tg")) & F.col("difference").isNotNull(), "left")
    return out.select(F.col("tg").cast(kind).alias(group), F.coalesce("difference", nan).alias("difference"), F.coalesce("p", nan).alias("p"), "n")


def rdm(df: DataFrame, group: str, item: str, vec: str) -> DataFrame:
    """ST17: cosine distances of the pairs of each group's vectors: (group, a, b, distance). The groups
    must be samples of bounded size (see operators.joins.pairs_within)."""
    from pairloom.functions.vectors import cosine

    a = df.select(group, F.col(item).alias("a"), F.col(vec).alias("va"))
    b = df.select(group, F.col(item).alias("b"), F.col(vec).alias("vb"))
    return a.join(b, group).where("a < b").select(group, "a", "b", (1.0 - cosine(F.col("va"), F.col("vb"))).alias("distance"))


def rsa(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """ST17: Spearman correlation of two representations' distances over the same pairs."""
    return spearman(pairs, x, y)


def alignment_with_expected(peaks: DataFrame, family: str, region: str, expected: dict[str, list[str]]) -> DataFrame:
    """ST25: whether the peak's region is one of those expected; NULL where none is."""
    table = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.array(*[F.lit(r) for r in v]))])
    want = F.try_element_at(table, F.col(family))
    return peaks.withColumn("aligned", F.when(want.isNotNull(), F.array_contains(want, F.col(region))))

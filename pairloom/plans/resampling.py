"""Bootstrap and permutation tests of any of several statistics, without gathering a group.

Rows of one value are drawn together, so a draw needs counts of values only. These are dealt to
tasks by ranges (``part``). A statistic of moments needs the sums of every range; a quantile needs to know in
which range a draw's place falls, from the ranges' sizes in that draw, and there the same numbers are
drawn again from the same seeds. A group may be of any size: what leaves a task has the size of the draws.

Random streams are not those of other generators. Results depend on the seed and on where ranges
begin, the bootstrap's on the seed alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators import sampling
from pairloom.operators.counts import quantiles
from pairloom.plans.statistics import hypergeometric
from pairloom.session import settle, worker_path


@dataclass(frozen=True)
class Statistic:
    """``mean``, ``std``, ``var`` (of samples) or ``quantile`` of one sample; ``cohens_d`` of two."""

    name: str
    q: float = 0.5

    @property
    def placed(self) -> bool:
        return self.name == "quantile"

    def of(self, n, s, ss):
        """From count, sum and sum of squares, arrays or numbers; NaN where it isn't defined."""
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = s / n
            if self.name == "mean":
                return mean
            var = np.where(n > 1, np.maximum(ss - s * mean, 0) / (n - 1), np.nan)
            return var if self.name == "var" else np.sqrt(var)

    def between(self, a, b):
        """Of two samples' (n, s, ss): the difference, or the effect size (0 where it is degenerate)."""
        if self.name != "cohens_d":
            return self.of(*a) - self.of(*b)
        with np.errstate(divide="ignore", invalid="ignore"):
            (na, sa, qa), (nb, sb, qb) = a, b
            pooled = np.sqrt(np.maximum(qa - sa * sa / na + qb - sb * sb / nb, 0) / (na + nb - 2))
            return np.where((na >= 2) & (nb >= 2) & (pooled >= 1e-10), (sa / na - sb / nb) / pooled, 0.0)


MEAN, STD, VAR, MEDIAN, COHENS_D = Statistic("mean"), Statistic("std"), Statistic("var"), Statistic("quantile"), Statistic("cohens_d")


def _values(df: DataFrame, group: list[str], x: str, first: Column | None, times: str | None = None) -> DataFrame:
    """(g, x, c, k, part): how many rows have the value, how many of them are in the first sample; NULLs don't count.
    g is the group as JSON, part a range of (g, x): as many as give each core several, however few bytes they hold,
    since a value costs its draws. ``times`` is how often a row counts."""
    spark = df.sparkSession
    worker_path(spark)
    g = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}) if group else F.lit("{}")
    side = F.coalesce(first, F.lit(False)).cast("int") if first is not None else F.lit(0)
    n = F.col(times) if times else F.lit(1)
    # about the mean of a group's values squares lose no digits
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(g.alias("g"), F.col(x).cast("double").alias("x"), n.cast("bigint").alias("n"), (side * n).alias("f"))
    counts = rows.groupBy("g", "x").agg(F.sum("n").alias("c"), F.sum("f").alias("k"))
    return settle(counts.repartitionByRange(_ranges(df), "g", "x").withColumn("part", F.spark_partition_id()), "values")


def _ranges(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _apart(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt to as many tasks as there are ranges: a few bytes of values are a lot of draws."""
    return df.repartition(_ranges(df), *keys)


def _named(out: DataFrame, df: DataFrame, group: list[str]) -> DataFrame:
    if not group:
        return out.drop("g")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*group).schema)
    return out.withColumn("g", F.from_json("g", types)).select("g.*", *[c for c in out.columns if c != "g"])


RARE = 12  # rows of a value up to which its counts are looked up, and its divisions drawn row by row
AT_ONCE = 128  # values that are drawn together
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(z: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    z = (z ^ (z >> np.uint64(30))) * _M1
    z = (z ^ (z >> np.uint64(27))) * _M2
    return z ^ (z >> np.uint64(31))


@cache
def _steps(c: int) -> list[np.uint64]:
    """Where the Poisson distribution of mean c passes to the next number, in parts of 2^64."""
    out, p, total, k = [], math.exp(-c), 0.0, 0
    # a sum of rounded terms may stop short of 1: past the mean, terms that are too small to add end it as well
    while (total := total + p) < 1 - 2.0**-53 and (k <= c or p > 2.0**-60):
        out.append(np.uint64(int(total * 2.0**64)))
        k += 1
        p *= c / k
    return out


def _weights(seed: int, g: str, side: int, x: float, c: int, draws: int) -> np.ndarray:
    return _weights_of(seed, g, side, np.array([x]), np.array([c]), draws)[0]


def _weights_of(seed: int, g: str, side: int, x: np.ndarray, c: np.ndarray, draws: int) -> np.ndarray:
    """A row for each value: how often a draw takes it. A value has its own stream, whichever are drawn with it."""
    own = int.from_bytes(hashlib.blake2b(f"{seed}|{side}|{g}".encode(), digest_size=8).digest(), "little")
    start = _mixed(_mixed(np.asarray(x, np.float64).view(np.uint64) + _GOLDEN) ^ np.uint64(own))
    out = np.zeros((len(x), draws), np.int64)
    for n in np.unique(c).tolist():
        at = np.flatnonzero(c == n)
        if n > RARE:
            for i in at:
                out[i] = np.random.default_rng(int(start[i])).poisson(n, draws)
            continue
        u = _mixed(start[at, None] + np.arange(1, draws + 1, dtype=np.uint64) * _GOLDEN)
        w = np.zeros(u.shape, np.uint8)
        for step in _steps(n):
            more = u >= step
            if not more.any():
                break
            w += more
        out[at] = w
    return out


def _blocks(batch: pa.RecordBatch, keys: list[str]):
    """(key, row numbers) of a batch, ``AT_ONCE`` rows at most."""
    found: dict = {}
    for i, key in enumerate(zip(*[batch.column(k).to_pylist() for k in keys], strict=True)):
        found.setdefault(key, []).append(i)
    for key, rows in found.items():
        for i in range(0, len(rows), AT_ONCE):
            yield key, np.array(rows[i : i + AT_ONCE])


def bootstrap(df: DataFrame, group: list[str], x: str, statistic: Statistic = MEAN, first: Column | None = None, draws: int = 2000, ci: float = 0.95, seed: int = 42, times: str | None = None) -> DataFrame:
    """ST1: (group, value, lo, hi, n): the statistic and its percentile interval. With ``first`` it is that of two
    samples (the rows where it holds and the others): the difference, or Cohen's d. Poisson counts stand
    for resampling (T20); draws without a value are left out. ``times`` is how often a row counts."""
    values = _values(df, group, x, first, times)
    two = first is not None
    if statistic.placed:
        drawn = _placed_draws(values, statistic.q, two, draws, seed)
    else:
        drawn = _moment_draws(values, statistic, two, draws, seed)
    tail = (1 - ci) / 2
    # as many values as draws in a group
    ends = drawn.where(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("g").agg(F.percentile("v", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    out = observed(values, statistic, two).join(ends, "g", "left")
    return _named(out.select("g", "value", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("hi"), "n"), df, group)


def observed(values: DataFrame, statistic: Statistic, two: bool) -> DataFrame:
    """(g, value, n) of the sample itself; NULL where a sample is too small."""
    sides = _sides(values, two)
    if statistic.placed:
        of = quantiles(sides, ["g", "side"], "x", [statistic.q], times="c").select("g", "side", F.get("q", F.lit(0)).alias("v"), "n")
        value = F.max(F.when(F.col("side") == 1, F.col("v"))) - F.max(F.when(F.col("side") == 0, F.col("v"))) if two else F.max("v")
        return of.groupBy("g").agg(value.alias("value"), F.sum("n").alias("n"))
    center = values.groupBy("g").agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m"))
    d = F.col("x") - F.col("m")
    sums = sides.join(F.broadcast(center), "g").groupBy("g", "side").agg(F.sum("c").alias("n"), F.sum(d * F.col("c")).alias("s"), F.sum(d * d * F.col("c")).alias("ss"), F.first("m").alias("m"))
    n, s, ss = ({i: F.coalesce(F.max(F.when(F.col("side") == i, F.col(c))), F.lit(0)).cast("double") for i in (0, 1)} for c in ("n", "s", "ss"))
    mean = lambda i: F.try_divide(s[i], n[i])
    rest = lambda i: F.greatest(ss[i] - F.coalesce(s[i] * mean(i), F.lit(0.0)), F.lit(0.0))
    var = lambda i: F.when(n[i] > 1, rest(i) / (n[i] - 1))
    pooled = F.sqrt(F.try_divide(rest(1) + rest(0), n[1] + n[0] - 2))
    kinds = {"mean": mean, "var": var, "std": lambda i: F.sqrt(var(i))}
    if statistic.name == "cohens_d":
        value = F.when((n[1] >= 2) & (n[0] >= 2) & (pooled >= 1e-10), (mean(1) - mean(0)) / pooled).otherwise(0.0)
    else:
        of_one = kinds[statistic.name]
        value = of_one(1) - of_one(0) if two else of_one(0) + (F.max("m") if statistic.name == "mean" else 0)
    return sums.groupBy("g").agg(value.alias("value"), F.sum("n").alias("n"))


def _sides(values: DataFrame, two: bool) -> DataFrame:
    """(g, side, part, x, c): a row for each sample that has the value; the first is side 1."""
    if not two:
        return values.select("g", F.lit(0).alias("side"), "part", "x", "c")
    both = F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("k").alias("c")), F.struct(F.lit(0).alias("side"), (F.col("c") - F.col("k")).alias("c"))))
    return values.select("g", "part", "x", both.alias("s")).select("g", "s.side", "part", "x", "s.c").where("c > 0")


def _moment_draws(values: DataFrame, statistic: Statistic, two: bool, draws: int, seed: int) -> DataFrame:
    """(g, b, v)."""
    center = values.groupBy("g").agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m"))
    rows = _sides(values, two).join(F.broadcast(center), "g").select("g", "side", "x", "c", (F.col("x") - F.col("m")).alias("d"))  # a row for each group

    def run(batches):
        sums: dict = {}
        for batch in batches:
            x, c, d = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("x", "c", "d"))
            for (g, side), at in _blocks(batch, ["g", "side"]):
                w = _weights_of(seed, g, side, x[at], c[at], draws).astype(float)
                s = sums.setdefault((g, side), np.zeros((3, draws)))
                s += np.stack([np.ones(len(at)), d[at], d[at] * d[at]]) @ w
        for (g, side), s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * draws, pa.string()), pa.array([side] * draws, pa.int32()), pa.array(np.arange(draws)), *map(pa.array, s)], ["g", "side", "b", "n", "s", "ss"])

    parts = rows.mapInArrow(run, "g string, side int, b bigint, n double, s double, ss double")
    side = lambda c, i: F.sum(F.when(F.col("side") == i, F.col(c))).alias(f"{c}{i}")
    sums = parts.groupBy("g", "b").agg(*[side(c, i) for c in ("n", "s", "ss") for i in (0, 1)]).join(center, "g")

    def finish(batches):
        for batch in batches:
            a, b = ([np.nan_to_num(batch.column(f"{c}{i}").to_numpy(zero_copy_only=False).astype(float)) for c in ("n", "s", "ss")] for i in (1, 0))
            v = statistic.between(a, b) if two else statistic.of(*b) + (batch.column("m").to_numpy(zero_copy_only=False) if statistic.name == "mean" else 0)
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("b"), pa.array(np.asarray(v, float))], ["g", "b", "v"])

    return sums.mapInArrow(finish, "g string, b bigint, v double")


def _placed_draws(values: DataFrame, q: float, two: bool, draws: int, seed: int) -> DataFrame:
    """(g, b, v) of a quantile: sizes of the ranges in each draw, the range that holds the place, the value there."""
    sides = _sides(values, two)

    def sizes(batches):
        sums: dict = {}
        for batch in batches:
            x, c = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("x", "c"))
            for key, at in _blocks(batch, ["g", "side", "part"]):
                sums[key] = sums.get(key, 0) + _weights_of(seed, key[0], key[1], x[at], c[at], draws).sum(axis=0)
        for (g, side, part), w in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([g] * draws, pa.string()), pa.array([side] * draws, pa.int32()), pa.array([part] * draws, pa.int32()), pa.array(np.arange(draws)), pa.array(w.astype(np.int64))], ["g", "side", "part", "b", "w"])

    parts = sides.mapInArrow(sizes, "g string, side int, part int, b bigint, w bigint").groupBy("g", "side", "part", "b").agg(F.sum("w").alias("w"))
    parts = settle(parts, "range-sizes")
    own = Window.partitionBy("g", "side", "b")
    place = parts.select("*", (F.sum("w").over(own.orderBy("part")) - F.col("w")).alias("before"), F.sum("w").over(own).alias("n"))
    h = (F.col("n") - 1) * F.lit(q)
    at = place.where("n > 0").select("g", "side", "part", "b", "w", "before", F.floor(h).alias("low"), F.ceil(h).alias("high"), (h - F.floor(h)).alias("f"))
    here = at.where((F.col("low").between(F.col("before"), F.col("before") + F.col("w") - 1)) | (F.col("high").between(F.col("before"), F.col("before") + F.col("w") - 1)))

    made = pa.schema([("g", pa.string()), ("side", pa.int32()), ("b", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("f", pa.float64())])

    def find(inside: pa.Table, want: pa.Table) -> pa.Table:
        if not want.num_rows or not inside.num_rows:
            return made.empty_table()
        inside = inside.sort_by("x")
        g, side = inside["g"][0].as_py(), inside["side"][0].as_py()
        b = want["b"].to_numpy()
        seen, found = want["before"].to_numpy().astype(np.int64), {k: np.full(len(b), np.nan) for k in ("low", "high")}
        places = {k: want[k].to_numpy() for k in found}
        xs, cs = inside["x"].to_numpy(), inside["c"].to_numpy()
        for i in range(0, len(xs), AT_ONCE):
            for x, w in zip(xs[i : i + AT_ONCE], _weights_of(seed, g, side, xs[i : i + AT_ONCE], cs[i : i + AT_ONCE], draws), strict=True):
                after = seen + w[b]
                for k, v in found.items():
                    v[(seen <= places[k]) & (places[k] < after)] = x
                seen = after
        return pa.table([pa.array([g] * len(b), pa.string()), pa.array([side] * len(b), pa.int32()), pa.array(b), pa.array(found["low"]), pa.array(found["high"]), pa.array(want["f"].to_numpy().astype(float))], schema=made)

    own = ("g", "side", "part")
    cells = _apart(sides, *own).groupBy(*own).cogroup(_apart(here, *own).groupBy(*own)).applyInArrow(find, "g string, side int, b bigint, low double, high double, f double")
    low, high = (F.max(F.when(~F.isnan(c), F.col(c))) for c in ("low", "high"))
    each = cells.groupBy("g", "side", "b").agg((low + F.max("f") * (high - low)).alias("v"))
    if not two:
        return each.select("g", "b", "v")
    return each.groupBy("g", "b").agg((F.max(F.when(F.col("side") == 1, F.col("v"))) - F.max(F.when(F.col("side") == 0, F.col("v")))).alias("v"))


def permutation(df: DataFrame, group: list[str], x: str, first: Column, statistic: Statistic = MEAN, draws: int = 5000, seed: int = 42, times: str | None = None) -> DataFrame:
    """ST3: (group, difference, p, n): the statistic of the rows where ``first`` holds less that of the others (or
    Cohen's d), and the part of random divisions of all rows into samples of these sizes that differ as much,
    either side. NULL without rows on both sides. ``times`` is how often a row counts."""
    values = _values(df, group, x, first, times)
    sizes = values.groupBy("g", "part").agg(F.sum("c").alias("n"), F.sum("k").alias("k"))
    def start(g: str, *more: int) -> np.random.Generator:
        return np.random.default_rng([seed, zlib.crc32(g.encode()), *more])

    def allot(frame: pd.DataFrame) -> pd.DataFrame:
        """How many rows of each range a draw takes for the first sample, and takes in the ranges before: sizes of a
        group's ranges only."""
        frame = frame.sort_values("part")
        left, want, rng = int(frame["n"].sum()), np.full(draws, frame["k"].sum(), np.int64), start(frame["g"].iloc[0])
        taken, before, done, ends = [], [], np.zeros(draws, np.int64), []
        for size in frame["n"]:
            left -= size
            got = hypergeometric(rng, size, left, want)
            before.append(done.tobytes())
            taken.append(got.tobytes())
            done, want = done + got, want - got
        ends = np.cumsum(frame["n"]) - frame["n"]
        return pd.DataFrame({"g": frame["g"], "part": frame["part"], "taken": taken, "before": before, "above": ends, "n": int(frame["n"].sum()), "k": int(frame["k"].sum())})

    center = values.groupBy("g").agg((F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("m"), F.max(F.abs("x")).alias("far"))
    q = statistic.q if statistic.placed else None

    def draw(inside: pd.DataFrame, share: pd.DataFrame) -> pd.DataFrame:
        inside = inside.sort_values("x")
        s = share.iloc[0]
        g, part, want = s["g"], int(s["part"]), np.frombuffer(s["taken"], np.int64)
        left, rng, n1, n2 = int(inside["c"].sum()), start(s["g"], part), int(s["k"]), int(s["n"] - s["k"])
        sums, found = np.zeros((2, draws)), np.full((4, draws), np.nan)
        cut = np.frombuffer(s["before"], np.int64)
        seen = [cut, int(s["above"]) - cut]  # of either sample, in the ranges before
        places = [int(f((n - 1) * q)) for n in (n1, n2) for f in (math.floor, math.ceil)] if q is not None else []
        for v, c in zip(inside["x"], inside["c"], strict=True):
            left -= c
            if c <= RARE:  # one row after the other: a draw takes it with the chance of what it wants in what is left
                got = np.zeros(draws, np.int64)
                for rest in range(left + c, left, -1):
                    got += rng.random(draws) * rest < want - got
            else:
                got = hypergeometric(rng, c, left, want)
            want = want - got
            if q is None:
                d = v - s["m"]
                sums[0] += d * got
                sums[1] += d * d * got
                continue
            after = [seen[0] + got, seen[1] + c - got]
            for i, at in enumerate(places):
                found[i][(seen[i // 2] <= at) & (at < after[i // 2])] = v
            seen = after
        out = {"g": [g] * draws, "b": np.arange(draws), "s": sums[0], "ss": sums[1]}
        return pd.DataFrame(out | {f"v{i}": found[i] for i in range(4)})

    shares = sizes.groupBy("g").applyInPandas(allot, "g string, part int, taken binary, before binary, above bigint, n bigint, k bigint").join(F.broadcast(center), "g")
    drawn = _apart(values, "g", "part").groupBy("g", "part").cogroup(_apart(shares, "g", "part").groupBy("g", "part")).applyInPandas(draw, "g string, b bigint, s double, ss double, v0 double, v1 double, v2 double, v3 double")
    found = [F.max(F.when(~F.isnan(f"v{i}"), F.col(f"v{i}"))).alias(f"v{i}") for i in range(4)]
    sums = drawn.groupBy("g", "b").agg(F.sum("s").alias("s"), F.sum("ss").alias("ss"), *found)
    d = F.col("x") - F.col("m")
    whole = values.join(F.broadcast(center), "g").groupBy("g").agg(F.sum("c").alias("n"), F.sum("k").alias("k"), F.sum(d * F.col("c")).alias("t"), F.sum(d * d * F.col("c")).alias("tt"), F.max("far").alias("far"))
    seen = observed(values, statistic, True).select("g", F.col("value").alias("difference"))
    tested = sums.join(whole.where("k > 0 and k < n").join(seen, "g"), "g")

    def judge(batches):
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("s", "ss", "v0", "v1", "v2", "v3", "n", "k", "t", "tt", "difference", "far")}
            n1, n2 = col["k"], col["n"] - col["k"]
            if q is None:
                v = statistic.between((n1, col["s"], col["ss"]), (n2, col["t"] - col["s"], col["tt"] - col["ss"]))
            else:
                share = lambda n: (n - 1) * q - np.floor((n - 1) * q)
                v = col["v0"] + share(n1) * (col["v1"] - col["v0"]) - col["v2"] - share(n2) * (col["v3"] - col["v2"])
            # sums in another order differ in their last places
            hit = np.abs(v) >= np.abs(col["difference"]) - 1e-12 * np.maximum(1, 1 if statistic.name == "cohens_d" else col["far"])
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(hit.astype(float))], ["g", "hit"])

    p = tested.mapInArrow(judge, "g string, hit double").groupBy("g").agg(F.avg("hit").alias("p"))
    out = whole.select("g", "n", "k").join(seen, "g", "left").join(p, "g", "left")
    both = (F.col("k") > 0) & (F.col("k") < F.col("n"))
    return _named(out.select("g", F.when(both, F.col("difference")).alias("difference"), F.when(both, F.col("p")).alias("p"), "n"), df, group)


def equal_samples(df: DataFrame, group: str, ident: str, least: int = 5, seed: int = 42) -> DataFrame:
    """SMP5: as many rows of each group as the smallest has, of groups with ``least`` at least, by the order of a hash of
    the id; no task sorts a group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    small = sizes.agg(F.min("_n").alias("_m"))
    return sampling.least_hashed(df, group, ident, sizes.select(group).crossJoin(F.broadcast(small)), "_m", seed)  # one row


def n_adjusted(df: DataFrame, group: str, ident: str, metrics: list[str], control: str, least: int = 5, draws: int = 2000, permutations: int = 5000, statistic: Statistic = MEAN, seed: int = 42) -> DataFrame:
    """ST23: groups cut to the size of the smallest; for each focal group and metric the statistic with its interval,
    and against the control group Cohen's d and the permutation test's p: (group, metric, value, lo, hi,
    cohens_d, p, n). d and p are NULL where there is no control group; fewer than two groups give no row."""
    sample = settle(equal_samples(df, group, ident, least, seed).select(group, *metrics), "equal-samples")
    if sample.select(group).distinct().limit(2).count() < 2:
        sample = sample.where("false")
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    long = sample.select(F.col(group).cast("string").alias("group"), pairs.alias("p")).select("group", "p.metric", "p.x")
    long = settle(long.groupBy("group", "metric", "x").agg(F.count("*").alias("times")), "metric-values")
    focal = long.where(F.col("group") != control)
    ends = bootstrap(focal, ["group", "metric"], "x", statistic, draws=draws, seed=seed, times="times")
    # the control's rows, once for each focal group: as many copies as there are groups
    groups = F.broadcast(focal.select("group").distinct())
    other = long.where(F.col("group") == control).drop("group").join(groups, how="cross")
    both = focal.withColumn("focal", F.lit(True)).unionByName(other.select("group", "metric", "x", "times").withColumn("focal", F.lit(False)))
    both = settle(both, "focal-control")
    tests = permutation(both, ["group", "metric"], "x", F.col("focal"), statistic, permutations, seed, "times").select("group", "metric", "p")
    effect = observed(_values(both, ["group", "metric"], "x", F.col("focal"), "times"), COHENS_D, True)
    effect = _named(effect.select("g", F.col("value").alias("cohens_d")), both, ["group", "metric"])
    out = ends.join(tests, ["group", "metric"], "left").join(effect, ["group", "metric"], "left")
    return out.select("group", "metric", "value", "lo", "hi", F.when(F.col("p").isNotNull(), F.col("cohens_d")).alias("cohens_d"), "p", "n")

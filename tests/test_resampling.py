"""Resampling against slow versions over whole groups, and against all divisions of small ones."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators.counts import auroc, quantiles, running
from pairloom.plans import resampling as R
from pairloom.plans import statistics as T


def sample(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, float(rng.integers(30)) if k != "b" else float(rng.normal(1e6, 1)), bool(rng.integers(2))) for k in ("a", "b", None) for _ in range(n)]
    rows += [("a", None, True), ("a", float("nan"), False), ("one", 5.0, True)]
    return spark.createDataFrame(rows, "k string, x double, first boolean").repartition(5), rows


def slow_draws(rows, key, statistic, two, draws, seed=42):
    g = '{"k":null}' if key is None else f'{{"k":"{key}"}}'
    xs = {s: sorted({x for k, x, f in rows if k == key and x is not None and x == x and (not two or f == bool(s))}) for s in ((0, 1) if two else (0,))}
    count = lambda s, x: sum(1 for k, v, f in rows if k == key and v == x and (not two or f == bool(s)))
    weights = {s: np.stack([R._weights(seed, g, s, x, count(s, x), draws) for x in v]) for s, v in xs.items() if v}
    out = []
    for b in range(draws):
        v = {s: np.repeat(xs[s], w[:, b]) for s, w in weights.items()}
        if any(not len(a) for a in v.values()):
            continue
        if statistic.name == "cohens_d":
            out.append(slow_effect(v[1], v[0]))
        else:
            f = {"mean": np.mean, "std": lambda a: a.std(ddof=1) if len(a) > 1 else np.nan, "quantile": lambda a: np.quantile(a, statistic.q)}[statistic.name]
            out.append(f(v[1]) - f(v[0]) if two else f(v[0]))
    return np.percentile([v for v in out if v == v], [2.5, 97.5])


def slow_effect(a, b):
    pooled = np.sqrt(((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2))
    return 0.0 if min(len(a), len(b)) < 2 or pooled < 1e-10 else (a.mean() - b.mean()) / pooled


@pytest.mark.parametrize("statistic,two", [(R.MEAN, False), (R.STD, False), (R.MEDIAN, False), (R.Statistic("quantile", 0.9), False), (R.MEDIAN, True), (R.MEAN, True), (R.COHENS_D, True)])
def test_bootstrap_is_the_slow_one(spark, statistic, two):
    """However the values are split, also where the mean is far from zero."""
    df, rows = sample(spark, 60)
    first = F.col("first") if two else None
    got = {r.k: r for r in R.bootstrap(df, ["k"], "x", statistic, first, draws=60).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for key in ("a", "b", None):
        lo, hi = slow_draws(rows, key, statistic, two, 60)
        assert np.allclose([got[key].lo, got[key].hi], [lo, hi], rtol=1e-9, atol=1e-7)
    one = got["one"]
    if statistic.placed and not two or statistic.name == "mean" and not two:
        assert (one.value, one.lo, one.hi, one.n) == (5.0, 5.0, 5.0, 1)


def test_bootstrap_of_the_mean_is_the_earlier_one(spark):
    """Another stream, so the same interval only about."""
    df, _ = sample(spark, 400)
    a = {r.k: r for r in R.bootstrap(df.where("k = 'a'"), ["k"], "x", draws=2000).collect()}["a"]
    b = T.bootstrap(df.where("k = 'a' and not isnan(x)"), "k", "x", draws=2000).first()
    assert abs(a.value - b["mean"]) < 1e-9 and abs(a.lo - b.lo) < 0.15 and abs(a.hi - b.hi) < 0.15


@pytest.mark.parametrize("statistic", [R.MEAN, R.MEDIAN, R.COHENS_D, R.Statistic("quantile", 0.25)])
def test_permutation_is_about_that_of_all_divisions(spark, statistic):
    rows = [("k", float(x), i < 5) for i, x in enumerate([9, 7, 7, 8, 6, 1, 5, 6, 7, 2, 3])]
    df = spark.createDataFrame(rows, "k string, x double, first boolean").repartition(4)
    x = np.array([r[1] for r in rows])

    def apart(a, b):
        return {"mean": lambda: a.mean() - b.mean(), "cohens_d": lambda: slow_effect(a, b), "quantile": lambda: np.quantile(a, statistic.q) - np.quantile(b, statistic.q)}[statistic.name]()

    seen = apart(x[:5], x[5:])
    all_ = [apart(x[list(c)], np.delete(x, list(c))) for c in itertools.combinations(range(11), 5)]
    want = np.mean([abs(v) >= abs(seen) - 1e-9 for v in all_])
    got = R.permutation(df, ["k"], "x", F.col("first"), statistic, draws=4000).first()
    assert abs(got.difference - seen) < 1e-9 and got.n == 11
    assert abs(got.p - want) < 4 * np.sqrt(max(want * (1 - want), 1e-3) / 4000)


def test_permutation_over_many_ranges(spark, request):
    """A group whose values lie in several ranges has the p of one range, up to the draws."""
    rng = np.random.default_rng(3)
    rows = [("k", float(rng.normal() + 0.08 * (i % 2)), bool(i % 2)) for i in range(1500)]
    df = spark.createDataFrame(rows, "k string, x double, first boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert R._values(df, ["k"], "x", F.col("first")).select("part").distinct().count() > 2
    many = [R.permutation(df, ["k"], "x", F.col("first"), s, draws=3000).first() for s in (R.MEAN, R.MEDIAN)]
    x, f = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for got, stat in zip(many, (np.mean, np.median), strict=True):
        seen = stat(x[f]) - stat(x[~f])
        draws = []
        for _ in range(3000):
            p = rng.permutation(f)
            draws.append(abs(stat(x[p]) - stat(x[~p])) >= abs(seen))
        assert abs(got.difference - seen) < 1e-9 and abs(got.p - np.mean(draws)) < 0.05


def test_degenerate_permutations(spark):
    rows = [("same", 1.0, True), ("same", 1.0, False), ("one side", 1.0, True), ("one side", 2.0, True)]
    df = spark.createDataFrame(rows, "k string, x double, first boolean")
    for statistic in (R.MEAN, R.MEDIAN, R.COHENS_D):
        got = {r.k: (r.difference, r.p) for r in R.permutation(df, ["k"], "x", F.col("first"), statistic, draws=50).collect()}
        assert got == {"same": (0.0, 1.0), "one side": (None, None)}
    assert R.permutation(df.where("k = 'no'"), ["k"], "x", F.col("first"), draws=50).count() == 0
    assert R.bootstrap(df.where("k = 'no'"), ["k"], "x", R.MEDIAN, draws=50).count() == 0


def test_n_adjusted_report(spark):
    rng = np.random.default_rng(5)
    rows = [(i, g, float(rng.normal(2 * (g == "far"), 1)), float(i % 7)) for i, g in enumerate(["far"] * 90 + ["near"] * 60 + ["control"] * 40 + ["tiny"] * 3)]
    df = spark.createDataFrame(rows, "id long, g string, m1 double, m2 double")
    got = {(r.group, r.metric): r for r in R.n_adjusted(df, "g", "id", ["m1", "m2"], "control", draws=200, permutations=500).collect()}
    assert set(got) == {(g, m) for g in ("far", "near") for m in ("m1", "m2")}
    assert {r.n for r in got.values()} == {40} and got["far", "m1"].p == 0.0 and got["far", "m1"].cohens_d > 1.2 and got["near", "m1"].p > 0.01
    assert all(r.lo <= r.value <= r.hi for r in got.values())
    no_control = R.n_adjusted(df.where("g <> 'control'"), "g", "id", ["m1"], "control", draws=50, permutations=50).collect()
    assert len(no_control) == 2 and all(r.p is None and r.cohens_d is None for r in no_control)
    assert R.n_adjusted(df.where("g = 'far'"), "g", "id", ["m1"], "control", draws=50, permutations=50).count() == 0


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k in (1, 2, None) for v in rng.integers(0, 40, 101 + (k or 0))] + [(9, 4.0), (8, None)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {r.k: (r.n, r.q) for r in quantiles(df, ["k"], "x", probs).collect()}
    assert set(got) == {1, 2, None, 9}
    for k, (n, q) in got.items():
        x = [v for g, v in rows if g == k]
        assert n == len(x) and np.allclose(q, np.quantile(x, probs), rtol=1e-12)
    whole = quantiles(df, [], "x", [0.5]).first()
    assert whole.q == [np.median([v for _, v in rows if v is not None])]
    assert quantiles(df.where("k = 77"), ["k"], "x", probs).count() == 0


def test_running_sums(spark):
    df = spark.createDataFrame([(None, 3, 1), (None, 1, 2), (1, 5, 10), (1, None, 4), (1, 7, 1)], "g int, v int, n int")
    got = {(r.g, r.v): r.n_before for r in running(df, ["g"], "v", ["n"]).collect()}
    assert got == {(None, 1): 0, (None, 3): 2, (1, None): 0, (1, 5): 4, (1, 7): 14}


def test_auroc_with_ties_nulls_and_one_class(spark):
    rows = [("k", s, y) for s, y in [(0.1, False), (0.4, True), (0.4, False), (0.8, True), (0.8, True), (0.2, False), (None, True), (0.5, None)]] + [("one", 0.3, True)]
    got = {r.k: (r.auroc, r.n_positive, r.n_negative) for r in auroc(spark.createDataFrame(rows, "k string, s double, y boolean"), ["k"], "s", F.col("y")).collect()}
    assert got == {"k": ((2.5 + 3 + 3) / 9, 3, 3), "one": (None, 1, 0)}


def test_correlations_without_a_join(spark, capsys):
    rng = np.random.default_rng(2)
    rows = [(k, i, float(rng.normal() + k % 3 + 1e5)) for k in range(200) for i in "abc" if rng.random() < 0.8]
    rows += [(k, "flat", 0.1) for k in range(200)] + [(1, "a", 2e5), (2, "b", None), (900, "b", None)]
    df = spark.createDataFrame(rows, "k int, i string, v double").repartition(5)
    got = {(r.a, r.b): (r.r, r.n) for r in T.pearson_matrix(df, "k", "i", "v").collect()}
    cell = {}
    for k, i, v in rows:
        cell.setdefault((k, i), []).append(v)
    mean = {c: np.mean([x for x in v if x is not None]) if any(x is not None for x in v) else None for c, v in cell.items()}
    for a, b in itertools.combinations_with_replacement(["a", "b", "c", "flat"], 2):
        keys = [k for k in {k for k, _ in cell} if (k, a) in cell and (k, b) in cell]
        pairs = np.array([(mean[k, a], mean[k, b]) for k in keys if mean[k, a] is not None and mean[k, b] is not None])
        r, n = got[a, b]
        assert n == len(keys)
        if "flat" in (a, b):
            assert r is None
        else:
            assert abs(r - np.corrcoef(pairs.T)[0, 1]) < 1e-7
    assert T.pearson_matrix(df.where("k < 0"), "k", "i", "v").count() == 0


def test_quantile_queries_hold_no_buffer(spark, sf, capsys):
    from pairloom.plans import load

    for name in ("summary_stats", "bin_rates", "pearson_matrix"):
        load().QUERIES[name](spark, sf).explain("formatted")
        plan = capsys.readouterr().out
        assert "percentile" not in plan and "SortMergeJoin [l_orderkey" not in plan

"""Distributed probes against fits in one process."""

import numpy as np
import pytest

from pairloom.plans import left_out, probe_sweep
from pairloom.plans.probe_sweep import Model
from pairloom.plans.probes import fit_binary, fit_logistic
from pairloom.session import table


def frame(spark, keys, n, d, classes, shift=0.6, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in keys:
        for i in range(n):
            y = int(rng.integers(classes))
            rows.append((k, f"c{y}", i // 2, (rng.normal(size=d) * (1 + np.arange(d)) + shift * y + 3).tolist()))
    return spark.createDataFrame(rows, "key string, y string, group long, v array<double>").repartition(7)


def scaled(models_rows, key):
    rows = [r for r in models_rows if r.key == key]
    x, y = np.array([r.v for r in rows]), np.array([r.y for r in rows])
    std = x.std(axis=0)
    return (x - x.mean(axis=0)) / std, y


@pytest.mark.parametrize("curved", [1024, 0])
def test_weights_are_those_of_one_process(spark, curved):
    """Newton's and L-BFGS's steps, three classes (all weights) and two (one weight vector)."""
    for classes in (3, 2):
        df = frame(spark, ["a", "b"], 150, 4, classes)
        spread = probe_sweep.moments(df)
        models = {k: Model([f"c{i}" for i in range(classes)], mean, 1 / std, 1.0) for k, (mean, std) in spread.items()}
        probe_sweep.fit(df, models, curved=curved)
        rows = df.collect()
        for key, m in models.items():
            x, y = scaled(rows, key)
            if classes == 2:
                want = fit_binary(x, (y == "c1").astype(float), 1.0)
                assert np.abs(m.w[1] - m.w[0] - want).max() < 1e-6
            else:
                want = fit_logistic(x, y, 1.0, steps=400)
                want -= want.mean(axis=0)  # which changes no chance, and is where the ridge ends
                assert np.abs(m.w - want).max() < 1e-6


def test_weights_on_embeddings(spark, sf):
    df = table(spark, sf, "embeddings").selectExpr("'all' as key", "cast(label as string) as y", "cast(embedding as array<double>) as v")
    mean, std = probe_sweep.moments(df)["all"]
    classes = [str(i) for i in range(10)]
    models = probe_sweep.fit(df, {"all": Model(classes, mean, 1 / std, 1.0)})
    rows = df.collect()
    x, y = (np.array([r.v for r in rows]) - mean) / std, np.array([r.y for r in rows])
    want = fit_logistic(x, y, 1.0, steps=1500)
    want -= want.mean(axis=0)  # which changes no chance, and is where the ridge ends
    assert np.abs(models["all"].w - want).max() < 1e-5


def test_moments_are_exact_far_from_zero(spark):
    x = np.random.default_rng(1).normal(size=(400, 3)) + 1e7
    df = spark.createDataFrame([("k", r.tolist()) for r in x], "key string, v array<double>").repartition(9)
    mean, std = probe_sweep.moments(df)["k"]
    assert np.allclose(mean, x.mean(axis=0), rtol=1e-12) and np.allclose(std, x.std(axis=0), rtol=1e-6)


def test_balanced_classes_weigh_alike(spark):
    rows = [("k", "lo" if i % 10 else "hi", i, [2.0 * (i % 10 == 0) + (i * 7 % 11) / 4]) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, y string, group long, v array<double>")
    plain, even = (probe_sweep.sweep(df, ["key"], "v", "y", "group", balanced=b).first() for b in (False, True))
    assert even.balanced_accuracy > plain.balanced_accuracy and even.n_classes == 2


def test_splits_that_cannot_be_scored(spark):
    rows = [("one class", "a", i, [1.0]) for i in range(20)]
    rows += [("lost", "ab"[i % 2], i, [float(i)]) for i in range(40)] + [("lost", "z", 9999, [1.0])]
    rows += [("few groups", "ab"[i % 2], i % 3, [float(i % 2) + i % 5]) for i in range(90)]
    rows += [(None, "ab"[i % 2], i, [float(i % 2) * 9]) for i in range(60)] + [("null", None, 1, [1.0]), ("null", "a", 1, None)]
    df = spark.createDataFrame(rows, "key string, y string, group long, v array<double>")
    got = {r.key: r for r in probe_sweep.sweep(df, ["key"], "v", "y", "group").collect()}
    assert set(got) == {"one class", "lost", "few groups", None}
    assert got["one class"].error == "single_class" and got["one class"].accuracy is None
    assert got["lost"].error in (None, "train_missing_class")
    assert got["few groups"].splitter == "stratified_shuffle_fallback" and got["few groups"].error is None and got["few groups"].n_examples == 90
    assert got[None].accuracy == 1.0 and got[None].auroc == 1.0 and got[None].f1 == 1.0
    assert probe_sweep.sweep(df.where("key = 'none'"), ["key"], "v", "y", "group").count() == 0


def refits(x, y, c):
    w = [fit_binary(x[np.arange(len(y)) != i], y[np.arange(len(y)) != i], c) for i in range(len(y))]
    return sum((np.append(x[i], 1) @ w[i] > 0) == (y[i] > 0) for i in range(len(y))), np.mean(w, axis=0)[:-1]


@pytest.mark.parametrize("chunk", [1024, 40])
def test_left_out_is_n_refits(spark, monkeypatch, chunk):
    """In one chunk, and in many that meet each other."""
    monkeypatch.setattr(left_out, "CHUNK", chunk)
    df = frame(spark, ["a", "b"], 120, 5, 2, shift=0.8, seed=3).selectExpr("key", "v", "y = 'c1' as y")
    for components, c in ((None, 0.1), (3, 0.05)):
        found, coefs = left_out.leave_one_out(df, "key", "v", "y", components, c)
        got, mean = {r.key: r for r in found.collect()}, {(r.key, r.place): r.mean_coef for r in coefs.collect()}
        for key in "ab":
            rows = [r for r in df.collect() if r.key == key]
            x, y = np.array([r.v for r in rows]), np.array([float(r.y) for r in rows])
            x = x - x.mean(axis=0)
            if components:
                x = x @ np.linalg.svd(x, full_matrices=False)[2][:components].T
            hits, want = refits(x / x.std(axis=0), y, c)
            assert (got[key].hits, got[key].n) == (hits, 120)
            assert np.allclose(np.abs([mean[key, k] for k in range(len(want))]), np.abs(want), atol=1e-6)


def test_left_out_of_odd_groups(spark):
    rows = [("two", [float(i)], i == 0) for i in range(2)] + [("same", [float(i)], True) for i in range(9)]
    rows += [("single", [float(i)], i == 0) for i in range(9)] + [(None, [float(i)], i > 4) for i in range(10)] + [("two", None, True), ("two", [1.0], None)]
    df = spark.createDataFrame(rows, "key string, v array<double>, y boolean")
    found, coefs = left_out.leave_one_out(df, "key", "v", "y", None, 1.0)
    got = {r.key: (r.hits, r.n) for r in found.collect()}
    assert got["two"] == (None, 2) and got["same"] == (None, 9) and got["single"] == (8, 9)
    x = np.arange(10.0)
    assert got[None] == (refits(((x - x.mean()) / x.std())[:, None], x > 4, 1.0)[0], 10)
    assert {r.key for r in coefs.collect()} == {"single", None}
    assert [r["rank"] for r in left_out.ranked_coefficients(coefs, "key").collect()] == [1, 1]
    assert left_out.leave_one_out(df.where("key = 'no'"), "key", "v", "y")[0].count() == 0


def no_step(*_):
    raise AssertionError("an exact step over all rows")


def test_equal_rows_are_refitted_once(spark, monkeypatch):
    """However often they come: six different rows need no blocks."""
    monkeypatch.setattr(left_out, "_step", no_step)
    rows = [("k", [float(b == i) for i in range(3)], i_ % 10 < 3 + 2 * b) for b in range(3) for i_ in range(800)]
    df = spark.createDataFrame(rows, "key string, v array<double>, y boolean").repartition(5)
    got = left_out.leave_one_out(df, "key", "v", "y", None, 1e4)[0].first()
    # 3, 5 and 7 of 10 are positive; of the band of equal halves every row is a miss
    assert (got.hits, got.n) == (560 + 0 + 560, 2400)


def test_large_groups_need_no_exact_steps(spark, monkeypatch):
    """The expansion's bound holds for all rows of a large group, and the refits are those from scratch."""
    monkeypatch.setattr(left_out, "_step", no_step)
    rng = np.random.default_rng(8)
    x, noise = rng.uniform(-1, 1, (4000, 3)), rng.normal(size=4000)
    y = x[:, 0] - x[:, 1] / 2 + noise > 0.1
    df = spark.createDataFrame([("k", v.tolist(), bool(t)) for v, t in zip(x, y, strict=True)], "key string, v array<double>, y boolean").repartition(5)
    found, coefs = left_out.leave_one_out(df, "key", "v", "y", None, 0.1)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    hits, want = refits(z, y.astype(float), 0.1)
    assert found.first().hits == hits
    assert np.allclose([r.mean_coef for r in coefs.orderBy("place").collect()], want, atol=1e-7)


def test_two_classes_go_to_the_refits_in_blocks(spark, monkeypatch):
    """Keys of two classes meet no task that holds the group; keys of more keep the other way."""
    from pairloom.plans import probes

    seen, plain = [], left_out.leave_one_out
    monkeypatch.setattr(left_out, "leave_one_out", lambda df, *a: seen.append(sorted(r[0] for r in df.select("g").distinct().collect())) or plain(df, *a))
    rows = [(k, [float(i), float(i * i % 7)], "abc"[i * (2 if k == "two" else 3) // 40]) for k in ("two", "three") for i in range(40)]
    got = {r.k: r for r in probes.leave_one_out(spark.createDataFrame(rows, "k string, v array<double>, y string"), "k", "v", "y", 2, 1.0).collect()}
    assert seen == [["two"]] and {k: r.n for k, r in got.items()} == {"two": 40, "three": 40} and got["two"].accuracy > 0.9

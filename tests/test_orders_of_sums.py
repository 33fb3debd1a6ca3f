"""Results that must not hang on the order in which rows meet."""

import random

from pyspark.sql import functions as F

from pairloom.operators import quality


def test_confidences_are_added_in_sequence(spark):
    """However passes are dealt out, the mean is that of one pass after another."""
    rng = random.Random(4)
    rows = [(k, n % 3, n, rng.randrange(1, 51) / 50.0 if n % 6 else None) for k in range(300) for n in range(1, 12)]
    field = F.lit("valid")
    made = spark.createDataFrame(rows, "k int, o int, row int, annotation_confidence double").select(
        "*", field.alias("counterfactual_validity"), field.alias("clinical_coherence"), field.alias("target_attribute_role"), field.alias("gold_answer_invariance"),
        field.alias("text"), F.lit(None).cast("string").alias("reason_if_null"), F.array().cast("array<string>").alias("uncertainty_flags"),
    )
    want = {}
    for k in range(300):
        total, n = 0.0, 0
        for r in rows:
            if r[0] == k and r[3] is not None:
                total, n = total + r[3], n + 1
        want[k] = total / n
    for seed in range(3):
        mixed = made.orderBy(F.rand(seed)).repartition(7)
        got = quality.reconcile(mixed, ["k"], "o", [], "row")
        assert {r.k: r.mean_confidence for r in got.collect()} == want


def test_values_are_dealt_to_many_ranges(spark):
    """A few bytes of values are a lot of draws: their ranges are not put together by size."""
    from pairloom.plans import resampling as R

    df = spark.createDataFrame([("k", float(i)) for i in range(3000)], "k string, x double")
    assert R._values(df, ["k"], "x", None).select("part").distinct().count() >= 12


def test_streams_of_values(spark):
    """Poisson counts, the same for a value whichever are drawn with it."""
    import numpy as np

    from pairloom.plans import resampling as R

    x, c = np.arange(40.0), np.array([1, 2, 12, 50] * 10)
    rows = R._weights_of(7, "g", 0, x, c, 5000)
    for i, n in enumerate(c):
        assert abs(rows[i].mean() - n) < 5 * (n / 5000) ** 0.5 and abs(rows[i].var() / n - 1) < 0.12
    assert all((R._weights(7, "g", 0, float(x[i]), int(c[i]), 5000) == rows[i]).all() for i in range(8))
    assert np.abs(np.corrcoef(rows) - np.eye(40)).max() < 0.08


def test_equal_samples_sort_no_group(spark, capsys):
    """Only rows at the edge are sorted; the sample is that of the hash order."""
    import hashlib

    from pairloom.operators import sampling

    rows = [(i, "a" if i % 3 else "b") for i in range(900)] + [(1000 + i, None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(4)
    out = sampling.equalised(df, "g", "id")
    order = lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i)
    want = {(i, g) for g in "ab" for i in sorted((i for i, k in rows if k == g), key=order)[:300]}
    assert {(r.id, r.g) for r in out.collect()} == want
    out.explain("formatted")
    assert "_edge" in capsys.readouterr().out

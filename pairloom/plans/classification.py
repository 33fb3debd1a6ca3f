"""Scores of classifiers from their predictions: confusion, scores of each class, reports of whole groups.

Everything after the confusion counts has as many rows as there are groups and classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.counts import auroc, same

__all__ = ["auroc", "class_scores", "confusion", "report"]


def confusion(df: DataFrame, group: list[str], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """ST13: (group, truth, guess, n); rows without a class or a guess don't count."""
    rows = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    return rows.groupBy(*group, F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def class_scores(matrix: DataFrame, group: list[str]) -> DataFrame:
    """ST13: (group, class, support, predicted, hits, precision, recall, f1) for each class that is true or guessed
    somewhere; precision and recall are NULL where they have no rows, f1 is 0 there."""
    sides = matrix.select(
        *group, "n", F.explode(F.array(F.struct(F.col("truth").alias("class"), F.lit(True).alias("is_truth")), F.struct(F.col("guess").alias("class"), F.lit(False).alias("is_truth")))).alias("s"), (F.col("truth") == F.col("guess")).alias("hit")
    )
    made = sides.groupBy(*group, F.col("s.class").alias("class")).agg(
        F.coalesce(F.sum(F.when(F.col("s.is_truth"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("s.is_truth"), F.col("n"))), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.when(F.col("s.is_truth") & F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"),
    )
    return made.withColumns({
        "precision": F.try_divide(F.col("hits").cast("double"), F.col("predicted")),
        "recall": F.try_divide(F.col("hits").cast("double"), F.col("support")),
        "f1": 2.0 * F.col("hits") / F.greatest(F.col("support") + F.col("predicted"), F.lit(1)),
    })


def report(matrix: DataFrame, group: list[str], train: DataFrame) -> DataFrame:
    """ST13: of test predictions (confusion counts) and the training classes (group, class, n): accuracy, balanced
    accuracy, macro and weighted F1, chance and majority baselines, the lifts over both, and the gain
    of balanced accuracy over chance, normalised. A majority baseline is the largest class's share of the
    training rows; the number of classes counts those of either side."""
    scores = class_scores(matrix, group)
    test = scores.groupBy(*group).agg(
        F.sum("support").alias("n_test"), (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )
    tested = matrix.select(*group, F.col("truth").alias("class"), F.lit(0).cast("bigint").alias("n"))
    seen = train.select(*group, "class", F.col("n").cast("bigint").alias("n")).unionByName(tested).groupBy(*group, "class").agg(F.sum("n").alias("n"))
    base = seen.groupBy(*group).agg(F.sum("n").alias("n_train"), F.count("*").alias("n_classes"), (F.max("n") / F.nullif(F.sum("n"), F.lit(0))).alias("majority_baseline"))
    out = same(test, base, group)
    chance = 1.0 / F.col("n_classes")
    return out.withColumns({
        "uniform_chance": chance,
        "lift_over_majority": F.col("accuracy") - F.col("majority_baseline"),
        "lift_over_uniform": F.col("accuracy") - chance,
        "normalized_gain": F.when(F.col("n_classes") > 1, (F.col("balanced_accuracy") - chance) / F.nullif(1.0 - chance, F.lit(0.0))).otherwise(0.0),
    })

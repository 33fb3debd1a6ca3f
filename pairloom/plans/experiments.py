"""Result tables of model runs: the metrics and summaries that follow from logits, vectors and conditions.

Running a model is outside the engine; its outputs are the input tables here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators.aggregates import by_strata, centroid
from pairloom.operators.windows import top_k

RENAMED = {  # fixed values: older names of attention summaries
    "mass_to_edit_region": "edit_mass",
    "mass_to_largest_edit_region": "largest_edit_mass",
    "mass_to_question_span": "stem_mass",
    "attention_entropy": "entropy",
}


def current_names(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """PRJ29: columns under their present names; where both exist the present one wins."""
    for old, new in (names or RENAMED).items():
        if old in df.columns and new in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old)
        elif old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df


def pooled(long: DataFrame, keys: list[str], vec: str, pos: str, scopes: dict[str, Column]) -> DataFrame:
    """ARR9 / ARR15: a mean vector for each scope (a condition on the token's place), with how many tokens it
    took and whether there were any: (keys, scope, centroid, n, valid)."""
    names = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(s)) for s, c in scopes.items()]))
    found = centroid(long.withColumn("scope", F.explode(names)), [*keys, "scope"], vec)
    every = long.select(*keys).distinct().withColumn("scope", F.explode(F.array(*[F.lit(s) for s in scopes])))
    out = every.join(found, [*keys, "scope"], "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "valid": F.col("n").isNotNull()})


def diff_summary(regions: Column, n_orig: Column, n_edited: Column) -> Column:
    """ARR13: of edit regions (see functions.text.edit_regions): how many, changed places of the edited text,
    the largest, and the ratio to the longer text."""
    size = F.transform(regions, lambda r: F.greatest(r["b_end"] - r["b_start"], r["a_end"] - r["a_start"]))
    changed = F.aggregate(size, F.lit(0), lambda s, x: s + x)
    return F.struct(
        F.size(regions).alias("n_edit_regions"), changed.alias("n_changed"), F.coalesce(F.array_max(size), F.lit(0)).alias("n_largest"),
        (changed / F.greatest(n_orig, n_edited, F.lit(1))).alias("edit_ratio"),
    )


def key_union(frames: list[DataFrame], first: list[str]) -> list[str]:
    """ARR14: the columns of several tables, each once: the priority ones, then in order of appearance."""
    seen = dict.fromkeys(c for df in frames for c in df.columns)
    return [c for c in first if c in seen] + [c for c in seen if c not in first]


def intervention_metrics(df: DataFrame, original: str, edited: str, patched: str, gold: str) -> DataFrame:
    """EXT8: per pair, from the three score arrays: gold score and margin, their changes, recovery and
    injection, flips and movement flags."""
    g = F.col(gold)
    names = ("logit", "margin", "prob", "pred")
    sides = {"o": original, "e": edited, "p": patched}
    # each score is computed once: what follows refers to columns, not to the arrays
    base = df.withColumns({f"_{s}_{n}": c for s, z in sides.items() for n, c in zip(names, (F.get(z, g), V.margin(F.col(z), g), V.gold_probability(F.col(z), g), V.prediction(F.col(z))), strict=True)})
    moved = base.withColumns({f"_d_{n}": F.col(f"_e_{n}") - F.col(f"_o_{n}") for n in names[:3]} | {f"_r_{n}": F.col(f"_p_{n}") - F.col(f"_o_{n}") for n in names[:3]})
    least = {"logit": V.EFFECT_GATE, "margin": V.EFFECT_GATE, "prob": V.PROBABILITY_EPSILON}
    pred = {s: F.col(f"_{s}_pred") for s in sides}
    out = moved.withColumns({
        "orig_correct": pred["o"] == g,
        "answer_flip": pred["o"] != pred["e"],
        "correctness_flip": (pred["o"] == g) != (pred["e"] == g),
        "pred_matches_orig": pred["p"] == pred["o"],
        "pred_matches_cf": pred["p"] == pred["e"],
        "is_significant": F.abs("_d_logit") >= V.EFFECT_GATE,
        **{f"recovery_{n}": V.recovery(F.col(f"_d_{n}"), F.col(f"_r_{n}"), least[n]) for n in names[:3]},
        **{f"injection_{n}": V.injection(F.col(f"_r_{n}"), F.col(f"_d_{n}"), least[n]) for n in names[:3]},
        **V.movement_flags(F.col("_d_logit"), F.col("_r_logit")),
    })
    return out.drop(*[c for c in out.columns if c[:3] in ("_o_", "_e_", "_p_", "_d_", "_r_")])


def strata_of(metrics: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """EXT9 / EXT10: the overlapping strata of a condition's pairs with statistics of every metric and rate."""
    strata = {"all": F.lit(True), "orig_correct": F.col("orig_correct"), "significant": F.col("is_significant"), "correct_sig": F.col("orig_correct") & F.col("is_significant"), "answer_flip_pairs": F.col("answer_flip"), "correctness_flip": F.col("correctness_flip")}
    values = {c: F.col(c) for c in metrics.columns if c.startswith(("recovery_", "injection_"))} | (extra or {})
    rates = {c: F.col(c) for c in ("pred_matches_orig", "pred_matches_cf", "answer_flip", "overshoot", "no_effect", "same_direction", "reversal", "attenuation", "amplification")}
    return by_strata(metrics, strata, values, rates)


# Weights of a layer's score.
ADDED, ABLATED, CONTROLS = 1.0, 1.0, 0.5


def layer_scores(runs: DataFrame, sample: int = 30, seed: int = 42) -> DataFrame:
    """EXT10: how well each layer serves an intervention on a family: (family, layer, score, added, ablated, control).

    ``runs`` has a row for each run: family, layer, ``run`` (``add``: the direction added to an original,
    ``ablate``: removed from an edited text, ``control``: added to a control's text), ``item``, and the
    margins ``base`` (of the text itself), ``original`` and ``after``. Of each family ``sample`` items are taken in
    hash order, and as many controls, those whose item is among the family's first. A layer's score is the mean
    |change| where the direction is added, plus the mean recovered part where it is removed (not under 0, 0 where
    there was no effect), less half the mean |change| of controls; a part without runs is 0. Runs without
    ``after`` (a span that was not found) don't count, but their items are among the sample."""
    items = runs.select("family", (F.col("run") == "control").alias("of_control"), "item").distinct()
    own = items.where(~F.col("of_control")).select("family", "item", F.lit(True).alias("matched"))
    marked = items.join(own, ["family", "item"], "left")
    order = [F.coalesce("matched", F.lit(False)).desc(), F.md5(F.concat(F.col("item").cast("string"), F.lit(f":{seed}"))), F.col("item")]
    # only controls are told apart by it; a family's own items all match
    taken = top_k(marked, ["family", "of_control"], order, sample).select("family", "of_control", "item")
    used = runs.withColumn("of_control", F.col("run") == "control").join(taken, ["family", "of_control", "item"])
    moved, effect = F.col("after") - F.col("base"), F.col("original") - F.col("base")
    known = F.when(F.abs(effect) < V.EFFECT_GATE, 0.0).otherwise(F.when(moved.isNotNull(), F.greatest(F.lit(0.0), F.try_divide(moved, effect))))
    mean = lambda run, x: F.coalesce(F.avg(F.when(F.col("run") == run, x)), F.lit(0.0))
    made = used.groupBy("family", "layer").agg(mean("add", F.abs(moved)).alias("added"), mean("ablate", known).alias("ablated"), mean("control", F.abs(moved)).alias("control"))
    return made.withColumn("score", ADDED * F.col("added") + ABLATED * F.col("ablated") - CONTROLS * F.col("control"))


def best_layers(scores: DataFrame) -> DataFrame:
    """EXT10: the layer of each family with the best score, the lower one on ties: (family, layer, score)."""
    top = F.max_by(F.struct("layer", "score"), F.struct(F.col("score"), (-F.col("layer")).alias("_l"))).alias("top")
    return scores.groupBy("family").agg(top).select("family", "top.layer", "top.score")


def baselines(df: DataFrame, question: str, layer: str, vec: str) -> tuple[DataFrame, DataFrame]:
    """EXT7: mean vectors by layer, and by question and layer."""
    return centroid(df, [layer], vec), centroid(df, [question, layer], vec)


def originals_once(pairs: DataFrame, question: str, columns: list[str]) -> DataFrame:
    """EXT11: one row per original for all its edited copies, to be run once and joined back."""
    return pairs.groupBy(question).agg(*[F.min(c).alias(c) for c in columns], F.count("*").alias("n_pairs"))


def examples(df: DataFrame, group: list[str], flip: Column, effect: Column, ident: str, n: int) -> DataFrame:
    """SRT6: n examples of each group, flips first, larger effects first."""
    return top_k(df, group, [flip.desc(), effect.desc(), F.col(ident)], n)


def verdicts(df: DataFrame) -> DataFrame:
    """VEC28: of family summaries (mean_delta_m_add, mean_rf_abl, mean_delta_m_rel, ctrl_effect): whether the
    direction suggests bias, is causal, hurts where it is relevant, and is specific."""
    effect = F.abs(F.coalesce("mean_delta_m_add", F.lit(0.0)))
    return df.withColumns({
        "suggests_bias": F.coalesce(F.col("mean_delta_m_add") < -0.01, F.lit(False)),
        "direction_causal": F.coalesce(F.col("mean_rf_abl") > 0.05, F.lit(False)),
        "hurts_relevant": F.coalesce(F.col("mean_delta_m_rel") < -0.01, F.lit(False)),
        "specificity_ratio": F.when(effect > 0.01, F.col("ctrl_effect") / F.when(effect > 0.01, effect)),
        "is_specific": F.when(effect > 0.01, F.col("ctrl_effect") < effect),
    })


def observed(df: DataFrame, name: str, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """DQ11: counters that fill in while the table is written, without a pass of their own."""
    watch = Observation(name)
    return df.observe(watch, *[F.count_if(c).alias(n) for n, c in counters.items()]), watch


def curve_data(df: DataFrame, series: list[str], x: str, y: str) -> DataFrame:
    """SNK14: what a line plot with error bands draws: mean, lower and upper (one standard error), n."""
    out = df.groupBy(*series, x).agg(F.avg(y).alias("mean"), (F.stddev_pop(y) / F.sqrt(F.count(y))).alias("sem"), F.count(y).alias("n"))
    return out.withColumns({"lower": F.col("mean") - F.col("sem"), "upper": F.col("mean") + F.col("sem")})

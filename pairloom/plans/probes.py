"""Probes over stored vectors: directions, threshold classifiers, principal components, logistic probes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.vectors import cosine, difference, dot, norm, unit
from pairloom.operators.aggregates import centroid
from pairloom.operators.sampling import group_split


def direction(df: DataFrame, keys: list[str], vec: str, positive: Column) -> DataFrame:
    """ST24: unit vector and norm of the difference of the two class means."""
    sides = centroid(df.withColumn("_side", positive), [*keys, "_side"], vec)
    a = sides.where("_side").select(*keys, F.col("centroid").alias("a"), F.col("n").alias("n_positive"))
    b = sides.where("not _side").select(*keys, F.col("centroid").alias("b"), F.col("n").alias("n_negative"))
    joined = a.join(b, keys) if keys else a.crossJoin(b)  # one row each
    raw = joined.withColumn("raw", difference(F.col("a"), F.col("b")))
    return raw.select(*keys, unit(F.col("raw")).alias("direction"), norm(F.col("raw")).alias("norm"), "n_positive", "n_negative")


def threshold_probe(df: DataFrame, vec: str, positive: Column) -> DataFrame:
    """ST12: accuracy of thresholding the projection on the difference of means at the mean projection."""
    side = df.withColumn("_y", positive)
    d = direction(df, [], vec, positive)
    scored = side.crossJoin(F.broadcast(d.select("direction"))).select("_y", dot(F.col(vec).cast("array<double>"), F.col("direction")).alias("s"))  # one row
    cut = scored.agg(F.avg("s").alias("cut"))
    return scored.crossJoin(F.broadcast(cut)).agg(F.avg((F.col("_y") == (F.col("s") > F.col("cut"))).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def projections(df: DataFrame, keys: list[str], vec: str, directions: DataFrame) -> DataFrame:
    """VEC9: every row's projection on its key's direction."""
    return df.join(directions.select(*keys, "direction"), keys).withColumn("projection", dot(F.col(vec).cast("array<double>"), F.col("direction")))


def coherence(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """VEC7: mean cosine over all pairs of a group, exactly and without pairs: from the norm of the sum of
    unit vectors, (|sum|^2 - n) / (n (n - 1)). Zero vectors are left out."""
    unit_rows = df.where(norm(F.col(vec).cast("array<double>")) >= 1e-10).withColumn("_u", unit(F.col(vec).cast("array<double>")))
    c = centroid(unit_rows, keys, "_u")
    n = F.col("n").cast("double")
    return c.select(*keys, F.when(n > 1, (dot(F.col("centroid"), F.col("centroid")) * n * n - n) / (n * (n - 1))).alias("coherence"), "n")


def centroid_alignment(df: DataFrame, key: str, vec: str) -> DataFrame:
    """ST20: cosine of the mean vectors of every two groups."""
    c = centroid(df, [key], vec)
    a = c.select(F.lit(1).alias("_k"), F.col(key).alias("a"), F.col("centroid").alias("va"))
    b = c.select(F.lit(1).alias("_k"), F.col(key).alias("b"), F.col("centroid").alias("vb"))
    return a.join(b, "_k").where("a < b").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cosine"))


def standardised(df: DataFrame, vec: str, ident: str, clip: float = 3.0) -> DataFrame:
    """ST26: all-zero vectors dropped, each dimension z-scored over the rows, clipped to +-3."""
    rows = df.where(F.exists(F.col(vec), lambda x: x != 0)).select(ident, F.col(vec).cast("array<double>").alias("v"))
    long = rows.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = long.agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("stats"))  # one row of the vector's length
    z = F.zip_with("v", "stats", lambda x, s: F.greatest(F.lit(-clip), F.least(F.lit(clip), F.when(s["s"] > 0, F.try_divide(x - s["m"], s["s"])).otherwise(0.0))))
    return rows.crossJoin(F.broadcast(stats)).select(ident, z.alias("z"))


def principal_components(df: DataFrame, vec: str, k: int, ident: str | None = None) -> tuple[DataFrame, list[float]]:
    """ST10: (rows with ``pc``, part of the variance explained by each component). Vectors are centred by
    the fit; Spark sums the Gram matrix, whose size is the square of the dimension."""
    rows = df.withColumn("_v", array_to_vector(F.col(vec).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows)
    keep = [ident] if ident else df.columns
    return model.transform(rows).select(*keep, vector_to_array("_pc").alias("pc")), [float(x) for x in model.explainedVariance.toArray()]


def fit_logistic(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 50) -> np.ndarray:
    """Multinomial logistic regression (ridge 1 / c, the intercepts free) by Newton steps on the diagonal
    blocks; a row of weights per class, the intercept last."""
    classes = np.unique(y)
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros((len(classes), x1.shape[1]))
    ridge = np.full(x1.shape[1], 1.0 / c)
    ridge[-1] = 1e-9
    for _ in range(steps):
        s = x1 @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        moved = 0.0
        for k, name in enumerate(classes):
            g = x1.T @ (p[:, k] - (y == name)) + ridge * w[k]
            h = (x1 * (p[:, k] * (1 - p[:, k]))[:, None]).T @ x1 + np.diag(ridge + 1e-9)
            step = np.linalg.solve(h, g) * (0.5 if len(classes) > 2 else 1.0)
            w[k] -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return w


def probe_metrics(truth: np.ndarray, guess: np.ndarray, train_truth: np.ndarray) -> dict[str, float]:
    """ST13: accuracy, balanced accuracy, macro F1, majority and chance baselines, lifts."""
    classes = np.unique(np.concatenate([truth, train_truth]))
    recall, f1 = [], []
    for k in classes:
        tp, fn, fp = ((truth == k) & (guess == k)).sum(), ((truth == k) & (guess != k)).sum(), ((truth != k) & (guess == k)).sum()
        if tp + fn:
            recall.append(tp / (tp + fn))
        f1.append(2 * tp / max(1, 2 * tp + fn + fp))
    accuracy = float((truth == guess).mean())
    names, counts = np.unique(train_truth, return_counts=True)
    majority = float((truth == names[counts.argmax()]).mean())
    balanced = float(np.mean(recall))
    chance = 1.0 / len(classes)
    return {"accuracy": accuracy, "balanced_accuracy": balanced, "macro_f1": float(np.mean(f1)), "majority_baseline": majority, "lift": accuracy - majority, "normalized_gain": (balanced - chance) / (1 - chance) if chance < 1 else 0.0}


METRICS = "accuracy double, balanced_accuracy double, macro_f1 double, majority_baseline double, lift double, normalized_gain double, n_train bigint, n_test bigint"


def layer_probes(df: DataFrame, layer: str, vec: str, label: str, group: str, test: float = 0.3, seed: int = 42, c: float = 1.0) -> DataFrame:
    """ST13-15: a probe for each layer, with a split by group; layers are independent tasks."""
    split = group_split(df, group, test, seed).select(layer, F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("string").alias("y"), "is_test", group)
    kind = df.schema[layer].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(group)
        x, y, te = np.stack(frame["v"].to_list()), frame["y"].to_numpy(), frame["is_test"].to_numpy()
        if te.all() or not te.any() or len(np.unique(y[~te])) < 2:
            return pd.DataFrame()
        mean, std = x[~te].mean(axis=0), x[~te].std(axis=0)
        z = (x - mean) / np.where(std > 0, std, 1)
        w = fit_logistic(z[~te], y[~te], c)
        guess = np.unique(y[~te])[(np.column_stack([z[te], np.ones(te.sum())]) @ w.T).argmax(axis=1)]
        return pd.DataFrame([{layer: frame[layer].iloc[0], **probe_metrics(y[te], guess, y[~te]), "n_train": int((~te).sum()), "n_test": int(te.sum())}])

    return split.groupBy(layer).applyInPandas(run, f"`{layer}` {kind}, {METRICS}")


def fit_binary(x: np.ndarray, y: np.ndarray, c: float, start: np.ndarray | None = None, steps: int = 100, n: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression of 0 or 1 (ridge 1 / c, the intercept, which is last, free), Newton steps that are
    halved until the loss falls. ``n`` is how often each row counts."""
    n = np.ones(len(y)) if n is None else n
    x1 = np.column_stack([x, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1.0 / c), 0.0)
    w = np.zeros(x1.shape[1]) if start is None else start.copy()
    loss = lambda v: n @ np.logaddexp(0, s := x1 @ v) - (n * y) @ s + ridge @ (v * v) / 2
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -500, 500)))
        step = np.linalg.solve((x1 * (n * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge + 1e-9), x1.T @ (n * (p - y)) + ridge * w)
        have = loss(w)
        while loss(w - step) > have + 1e-9 * max(1.0, 1e-6 * abs(have)) and np.abs(step).max() > 1e-10:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


HELD_OUT = 256  # refits of a task


def leave_one_out(df: DataFrame, key: str, vec: str, label: str, components: int = 50, c: float = 0.01) -> DataFrame:
    """ST11 / ST16 / SMP9: accuracy of leave-one-out logistic probes for each key. Principal components and
    scaling are those of the whole group; then the probe is fitted again without each row. Keys of two classes at most are
    left to :mod:`pairloom.plans.left_out`; with more, the refits of a group are dealt to tasks. Groups of fewer
    than three rows or of one class give NULL."""
    from pairloom.plans import left_out

    kind = df.schema[key].dataType.simpleString()
    said = df.select(F.col(key).cast("string").alias("g"), F.col(label).cast("string").alias("y"), vec).where("y is not null")
    classes = said.groupBy("g").agg(F.min("y").alias("low"), F.max("y").alias("high"))
    mixed = left_out.same(said.select("g", "y"), classes, ["g"]).where("y <> low and y <> high").select("g").distinct()
    many = [r.g for r in mixed.collect()]  # keys are layers or folds
    if not many:
        two = left_out.same(said, F.broadcast(classes.select("g", "high")), ["g"]).select("g", (F.col("y") == F.col("high")).alias("y"), vec)
        found, _ = left_out.leave_one_out(two, "g", vec, "y", components, c)
        return found.select(F.col("g").cast(kind).alias(key), "accuracy", "n")
    few = ~F.coalesce(F.col(key).cast("string").isin([g for g in many if g is not None]), F.lit(None in many))
    if not df.where(few).isEmpty():
        return leave_one_out(df.where(few), key, vec, label, components, c).unionByName(leave_one_out(df.where(~few), key, vec, label, components, c))

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        n, names = len(frame), sorted(frame["y"].dropna().unique())
        row = {"g": frame["g"].iloc[0], "n": n, "z": None, "y": None}
        if n >= 3 and len(names) >= 2:
            frame = frame.assign(t=frame["v"].map(tuple)).sort_values(["y", "t"])
            x = np.stack(frame["v"].to_list())
            x = x - x.mean(axis=0)
            _, _, vt = np.linalg.svd(x, full_matrices=False)
            z = x @ vt[: min(components, n - 1, x.shape[1])].T
            std = z.std(axis=0)
            row |= {"z": (z / np.where(std > 0, std, 1)).tobytes(), "y": np.searchsorted(names, frame["y"].to_numpy(str)).astype(np.int64).tobytes()}
        return pd.DataFrame([row])

    def refit(frame: pd.DataFrame) -> pd.DataFrame:
        r = frame.iloc[0]
        if r["z"] is None:
            return pd.DataFrame({"g": [r["g"]], "n": [r["n"]], "hits": [None]})
        y = np.frombuffer(r["y"], np.int64)
        z = np.frombuffer(r["z"], np.float64).reshape(len(y), -1)
        first, hits, two = int(r["part"]) * HELD_OUT, 0, y.max() == 1
        near = fit_binary(z, y, c) if two else None
        for i in range(first, min(first + HELD_OUT, len(y))):
            keep = np.arange(len(y)) != i
            classes = np.unique(y[keep])
            if len(classes) == 1:
                hits += classes[0] == y[i]
            elif two:
                hits += (np.append(z[i], 1) @ fit_binary(z[keep], y[keep], c, near) > 0) == y[i]
            else:
                hits += classes[(np.append(z[i], 1) @ fit_logistic(z[keep], y[keep], c).T).argmax()] == y[i]
        return pd.DataFrame({"g": [r["g"]], "n": [r["n"]], "hits": [int(hits)]})

    rows = df.select(F.col(key).cast("string").alias("g"), F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("string").alias("y")).where("y is not null")
    reduced = rows.groupBy("g").applyInPandas(reduce, "g string, n bigint, z binary, y binary")
    parts = F.when(F.col("z").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / HELD_OUT).cast("int")))
    counted = reduced.select("*", F.explode(parts).alias("part")).groupBy("g", "part").applyInPandas(refit, "g string, n bigint, hits bigint")
    out = counted.groupBy("g").agg((F.sum("hits") / F.first("n")).alias("accuracy"), F.first("n").alias("n"))
    return out.select(F.col("g").cast(kind).alias(key), "accuracy", "n")


def ward_clusters(df: DataFrame, ident: str, vec: str, cuts: tuple[int, ...] = (3, 5, 8)) -> DataFrame:
    """ST18: Ward clustering on cosine distances, labels at several cuts. For head profiles: as many rows
    as a model has heads, so one group; NULL labels where a cut has too few rows."""
    kind = df.schema[ident].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ident).reset_index(drop=True)
        x = np.stack(frame["v"].to_list())
        size = np.linalg.norm(x, axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.nan_to_num(1 - (x @ x.T) / np.outer(size, size), nan=1.0) ** 2
        np.fill_diagonal(d, np.inf)
        n, members = np.ones(len(x)), [[i] for i in range(len(x))]
        labels, alive = {}, list(range(len(x)))
        while alive:
            if len(alive) in cuts:
                first = sorted(alive, key=lambda i: min(members[i]))
                labels[len(alive)] = {m: k + 1 for k, i in enumerate(first) for m in members[i]}
            if len(alive) == 1:
                break
            sub = d[np.ix_(alive, alive)]
            a, b = divmod(int(sub.argmin()), len(alive))
            i, j = alive[min(a, b)], alive[max(a, b)]
            for k in alive:
                if k not in (i, j):
                    d[i, k] = d[k, i] = ((n[i] + n[k]) * d[i, k] + (n[j] + n[k]) * d[j, k] - n[k] * d[i, j]) / (n[i] + n[j] + n[k])
            n[i] += n[j]
            members[i] += members[j]
            alive.remove(j)
        return pd.DataFrame({ident: frame[ident]} | {f"cluster_{k}": [labels.get(k, {}).get(r) for r in range(len(x))] for k in cuts})

    rows = df.select(F.lit(1).alias("_g"), ident, F.col(vec).cast("array<double>").alias("v"))
    return rows.groupBy("_g").applyInPandas(lambda f: run(f), f"`{ident}` {kind}, " + ", ".join(f"cluster_{k} bigint" for k in cuts))

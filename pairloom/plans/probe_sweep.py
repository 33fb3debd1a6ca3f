"""Logistic probes for all keys (layers, tasks) at once, without gathering the rows of a key.

Rows stay where they are. Each pass sends the models to the tasks and adds up, per key, what the
next step needs (moments, or loss, gradient and curvature) in Arrow batches; partial sums are merged as a
tree. Steps are Newton's while classes times dimensions are at most ``CURVED``, whose square is then the
size of a key's sums, else L-BFGS's, with sums of the size of a model. What comes to the driver grows
with keys, classes and dimensions, never with rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.counts import auroc, same
from pairloom.plans.classification import confusion, report
from pairloom.session import settle, worker_path

CURVED = 1024  # classes x dimensions up to which steps are Newton's
CLASSES = 1_000_000  # keys x classes that may come to the driver
LEAST_GROUPS = 4  # of a key that is split by group
MEMORY = 10  # steps that L-BFGS remembers

Sums = dict[str, np.ndarray]


def tree_sums(rows: DataFrame, make: Callable[[pa.RecordBatch], Sums], merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> Sums:
    """``make``'s arrays by key, merged over batches, tasks and the tree."""
    worker_path(rows.sparkSession)

    def into(have: Sums, more: Sums) -> Sums:
        for k, v in more.items():
            have[k] = merge(have[k], v) if k in have else v
        return have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Sums = {}
        for batch in batches:
            into(sums, make(batch))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype(np.float64).tobytes() for v in sums.values()], pa.binary())], ["key", "sums"])

    parts = rows.mapInArrow(run, "key string, sums binary").rdd.map(lambda r: {r[0]: np.frombuffer(r[1])})
    return parts.treeAggregate({}, into, into, depth=2 if parts.getNumPartitions() <= 1024 else 3)


def by_key(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(key, row numbers, vectors) for each key of a batch with ``key`` and ``v``."""
    keys = np.array(batch.column("key").to_pylist(), object)
    vec = batch.column("v")
    flat, ends = vec.flatten().to_numpy(zero_copy_only=False), np.cumsum(vec.value_lengths().to_numpy(zero_copy_only=False))
    for key in dict.fromkeys(keys.tolist()):
        at = np.flatnonzero(keys == key)
        size = int(vec[int(at[0])].values.__len__())
        yield key, at, flat[(ends[at] - size)[:, None] + np.arange(size)]


def merged_moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two samples' (n, means, sums of squared deviations), flattened: those of both together."""
    d = len(a) // 2
    na, nb = a[0], b[0]
    delta, n = b[1 : 1 + d] - a[1 : 1 + d], na + nb
    return np.concatenate([[n], a[1 : 1 + d] + delta * nb / n, a[1 + d :] + b[1 + d :] + delta**2 * na * nb / n])


def moments(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(means, deviations) of each key's vectors; a deviation of 0 counts as 1."""

    def make(batch: pa.RecordBatch) -> Sums:
        out = {}
        for key, _, x in by_key(batch):
            mean = x.mean(axis=0)
            out[key] = np.concatenate([[len(x)], mean, ((x - mean) ** 2).sum(axis=0)])
        return out

    found = {}
    for key, s in tree_sums(rows.select("key", "v"), make, merged_moments).items():
        d = len(s) // 2
        # what rounding leaves of a constant is no deviation
        std = np.sqrt(s[1 + d :] / s[0])
        found[key] = s[1 : 1 + d], np.where(std > 1e-12 * np.maximum(1, np.abs(s[1 : 1 + d])), std, 1.0)
    return found


@dataclass
class Model:
    """A probe of one key: scores are ``((v - mean) @ into, 1) @ w.T``, a row of ``w`` for each class. ``into`` is a
    vector of factors or a projection."""

    classes: list[str]
    mean: np.ndarray
    into: np.ndarray
    ridge: float  # of the weights; the intercept is free
    w: np.ndarray = None
    weights: dict[str, float] | None = None  # of the classes

    def inputs(self, v: np.ndarray) -> np.ndarray:
        z = (v - self.mean) * self.into if self.into.ndim == 1 else (v - self.mean) @ self.into
        return np.column_stack([z, np.ones(len(z))])

    @property
    def size(self) -> int:
        return (len(self.into) if self.into.ndim == 1 else self.into.shape[1]) + 1

    def chances(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        s = x @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def penalty(self) -> np.ndarray:
        """Two classes share one weight vector, so each half of it bears twice the ridge."""
        return np.tile(np.append(np.full(self.size - 1, self.ridge * (2 if len(self.classes) == 2 else 1)), 0.0), (len(self.classes), 1))


@dataclass
class Descent:
    """Where the minimisation of one key stands."""

    model: Model
    at: np.ndarray  # the last point accepted
    step: np.ndarray  # from there; the trial is at + size * step
    size: float = 1.0
    loss: float = np.inf
    gradient: np.ndarray | None = None
    past: list = field(default_factory=list)
    done: bool = False

    def trial(self) -> np.ndarray:
        return self.at + self.size * self.step

    def judge(self, loss: float, gradient: np.ndarray, curve: np.ndarray | None, tolerance: float) -> None:
        """Take the trial if the loss fell, else halve the step."""
        w = self.trial()
        penalty = self.model.penalty()
        loss += float((penalty * w * w).sum()) / 2
        gradient = gradient + penalty * w
        if loss > self.loss + 1e-9 * max(1.0, abs(self.loss)) and self.size > 1e-6:
            self.size /= 2
            return
        moved = w - self.at
        if self.gradient is not None and (moved * (gradient - self.gradient)).sum() > 0:
            self.past = [*self.past, (moved, gradient - self.gradient)][-MEMORY:]
        self.done = self.gradient is not None and np.abs(moved).max() < tolerance
        self.at, self.loss, self.gradient, self.size = w, loss, gradient, 1.0
        self.step = self._newton(curve) if curve is not None else self._quasi()
        # what a step can still gain is lost in the loss's last places
        self.done = self.done or np.abs(self.step).max() < tolerance or -(self.step * gradient).sum() < 1e-14 * max(1.0, abs(loss))

    def _newton(self, curve: np.ndarray) -> np.ndarray:
        flat = np.tile(np.append(np.zeros(self.model.size - 1), 1e-9), len(self.model.classes))  # equal shifts of all intercepts change nothing
        return -np.linalg.solve(curve + np.diag(self.model.penalty().ravel() + flat), self.gradient.ravel()).reshape(self.at.shape)

    def _quasi(self) -> np.ndarray:
        q, scales = self.gradient.copy(), []
        for s, y in reversed(self.past):
            scales.append(a := (s * q).sum() / (s * y).sum())
            q -= a * y
        if self.past:
            s, y = self.past[-1]
            q *= (s * y).sum() / (y * y).sum()
        else:
            q /= max(1.0, np.linalg.norm(q))
        for (s, y), a in zip(self.past, reversed(scales), strict=True):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return -q


def fit(rows: DataFrame, models: dict[str, Model], tolerance: float = 1e-9, most: int = 500, curved: int = CURVED) -> dict[str, Model]:
    """The models with their weights, from ``rows`` (key, y, v); rows of other keys or classes don't count. Intercepts
    are centred, since only their differences matter."""
    going = {k: Descent(m, np.zeros((len(m.classes), m.size)), np.zeros((len(m.classes), m.size))) for k, m in models.items()}
    for _ in range(most):
        trials = {k: (d.model, d.trial()) for k, d in going.items() if not d.done}
        if not trials:
            break

        def make(batch: pa.RecordBatch, trials: dict = trials) -> Sums:
            labels, out = np.array(batch.column("y").to_pylist(), object), {}
            for key, at, v in by_key(batch):
                if key not in trials:
                    continue
                model, w = trials[key]
                place = {c: i for i, c in enumerate(model.classes)}
                y = np.array([place.get(c, -1) for c in labels[at].tolist()])
                x, y = model.inputs(v[y >= 0]), y[y >= 0]
                if not len(y):
                    continue
                weight = np.array([(model.weights or {}).get(c, 1.0) for c in model.classes])[y]
                p = model.chances(x, w)
                loss = -(weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
                gap = p.copy()
                gap[np.arange(len(y)), y] -= 1
                sums = [[loss], ((gap * weight[:, None]).T @ x).ravel()]
                if w.size <= curved:
                    k, size = w.shape
                    curve = np.zeros((k, size, k, size))
                    for a in range(k):
                        for b in range(a, k):
                            curve[a, :, b, :] = (x * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                            curve[b, :, a, :] = curve[a, :, b, :].T
                    sums.append(curve.ravel())
                out[key] = np.concatenate(sums)
            return out

        for key, s in tree_sums(rows.where(F.col("key").isin(list(trials))) if len(trials) < len(going) else rows, make).items():
            d = going[key]
            n = d.at.size
            d.judge(float(s[0]), s[1 : 1 + n].reshape(d.at.shape), s[1 + n :].reshape(n, n) if len(s) > 1 + n else None, tolerance)
    for key, d in going.items():
        d.at[:, -1] -= d.at[:, -1].mean()
        models[key].w = d.at
    return models


def predictions(rows: DataFrame, models: dict[str, Model], keep: list[str]) -> DataFrame:
    """``keep``, key, y, guess and (of two classes) the chance of the second; rows of other keys are left out."""
    worker_path(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guess, chance = np.full(len(batch), None, object), np.full(len(batch), np.nan)
            for key, at, v in by_key(batch):
                if model := sent.value.get(key):
                    p = model.chances(model.inputs(v), model.w)
                    guess[at] = np.array(model.classes, object)[p.argmax(axis=1)]
                    if len(model.classes) == 2:
                        chance[at] = p[:, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("key"), batch.column("y"), pa.array(guess, pa.string()), pa.array(chance, pa.float64(), from_pandas=True)], [*keep, "key", "y", "guess", "chance"])

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{types + ', ' if types else ''}key string, y string, guess string, chance double").where("guess is not null")


def grouped_split(rows: DataFrame, test: float, seed: int) -> DataFrame:
    """SMP8: ``rows`` (key, y, group, v) with ``is_test`` and ``splitter``. Keys with four groups at least are
    split by a hash of the group, so that no group is on both sides; the others, within each class, by a hash of the row."""

    def place(*parts: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / float(2**32)

    few = rows.select("key", "group").distinct().groupBy("key").agg(F.count("*").alias("_g")).where(F.col("_g") < LEAST_GROUPS).select("key", F.lit(True).alias("_few"))
    marked = same(rows, F.broadcast(few), ["key"], "left")  # a row for each key at most
    whole = F.col("_few").isNull()
    own = F.when(whole, place(F.col("group"))).otherwise(place(F.col("y"), F.xxhash64("group", "v")))
    return marked.select("key", "y", "group", "v", (own < test).alias("is_test"), F.when(whole, "group_shuffle").otherwise("stratified_shuffle_fallback").alias("splitter"))


def sweep(df: DataFrame, keys: list[str], vec: str, label: str, group: str, test: float = 0.3, seed: int = 42, c: float = 1.0, balanced: bool = False) -> DataFrame:
    """ST13-15: a probe for each key, trained on one side of a split by group and scored on the other: the columns of
    :func:`pairloom.plans.classification.report`, ``f1`` and ``auroc`` of the second class where there are two, the
    splitter, and ``error`` (with all else NULL) where a split is empty, has one class to train on, or lacks a
    tested one there. Features are scaled by the training rows; ``balanced`` weighs classes by their size.
    Rows without class or vector don't count."""
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = df.select(key.alias("key"), F.col(label).cast("string").alias("y"), F.col(group).cast("string").alias("group"), F.col(vec).cast("array<double>").alias("v")).where("y is not null and v is not null")
    split = grouped_split(rows, test, seed)
    counts = split.groupBy("key", "splitter", "is_test", "y").agg(F.count("*").alias("n"))
    sides: dict[str, dict] = {}
    for r in counts.limit(CLASSES).collect():
        side = sides.setdefault(r.key, {"train": {}, "test": {}, "splitter": r.splitter})
        side["test" if r.is_test else "train"][r.y] = r.n
    if sum(len(s["train"]) + len(s["test"]) for s in sides.values()) >= CLASSES:
        raise ValueError(f"{CLASSES} classes of all keys are no probes' classes")
    errors = {k: issue(s["train"], s["test"]) for k, s in sides.items()}
    fine = [k for k, e in errors.items() if e is None]
    spark = df.sparkSession
    train = split.where(~F.col("is_test") & F.col("key").isin(fine))
    models = {}
    for k, (mean, std) in (moments(train) if fine else {}).items():
        n = sides[k]["train"]
        even = {y: sum(n.values()) / (len(n) * m) for y, m in n.items()} if balanced else None
        models[k] = Model(sorted(n), mean, 1 / std, 1 / c, weights=even)
    models = fit(train.select("key", "y", "v"), models) if models else {}
    tested = settle(predictions(split.where(F.col("is_test") & F.col("key").isin(fine)), models, []), "probe-guesses")
    trained = spark.createDataFrame([(k, y, n) for k in fine for y, n in sides[k]["train"].items()], "key string, class string, n bigint")
    matrix = confusion(tested, ["key"], "y", "guess")
    scores = report(matrix, ["key"], trained)
    second = spark.createDataFrame([(k, sorted(sides[k]["train"])[1]) for k in fine if len(sides[k]["train"]) == 2], "key string, second string")
    of_two = tested.join(F.broadcast(second), "key")
    area = auroc(of_two, ["key"], "chance", F.col("y") == F.col("second")).select("key", "auroc")
    hit, said, true = (F.count_if(x) for x in ((F.col("y") == F.col("second")) & (F.col("guess") == F.col("second")), F.col("guess") == F.col("second"), F.col("y") == F.col("second")))
    f1 = of_two.groupBy("key").agg((2.0 * hit / F.greatest(said + true, F.lit(1))).alias("f1"))
    every = spark.createDataFrame([(k, s["splitter"], errors[k], sum(s["train"].values()) + sum(s["test"].values())) for k, s in sides.items()], "key string, splitter string, error string, n_examples bigint")
    out = every.join(scores, "key", "left").join(f1, "key", "left").join(area, "key", "left")  # a row for each key
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return out.withColumn("key", F.from_json("key", types)).select("key.*", *[n for n in out.columns if n != "key"])


def issue(train: dict[str, int], test: dict[str, int]) -> str | None:
    """SMP8: what is wrong with a split, by the classes of both sides."""
    if len(set(train) | set(test)) < 2:
        return "single_class"
    if not train or not test:
        return "empty_split"
    if len(train) < 2:
        return "single_class_train"
    return "train_missing_class" if set(test) - set(train) else None

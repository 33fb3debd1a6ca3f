"""Leave-one-out logistic probes: exact refits from one fit, and the coefficients' ranking.

The whole group is fitted once (:mod:`pairloom.plans.probe_sweep`). Rows of the same input and class have the same
refit, so rows are counted first. Leaving a row out changes the curvature there by a matrix of rank one, so the
first Newton step of every refit is known from the row alone. The steps after it need the gradient over all
other rows at each refit's own point. Refits lie near the whole fit: there the gradient's expansion to the second
order, three sums over the group, gives it up to a remainder that is bounded for each row, and falls with the
third power of the group's size. Only rows whose bound is over ``TOLERANCE`` (of small groups, or far from all
others) go on to exact gradients: in blocks that meet the chunks of their group's rows as matrix products. Steps
keep the changed curvature and stop below ``TOLERANCE``: the result is that of refits from scratch. Groups
of one chunk are refitted row by row in a task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.counts import same
from pairloom.plans.probes import fit_binary
from pairloom.plans.probe_sweep import Model, Sums, by_key, fit, moments, tree_sums
from pairloom.session import Scratch, worker_path

CHUNK = 1024  # rows
SLOTS = 32  # partial sums of a block meet in as many groups first
TOLERANCE = 1e-7
MOST = 60  # steps
THIRD = 96  # weights up to which gradients are expanded to the second order; their sums have half the third power of it
ROWS = 512  # of a product of pairs
WIDEST = 4096  # dimensions of vectors whose principal components are sought; their square comes to the driver


def projections(rows: DataFrame, spread: dict[str, tuple[np.ndarray, np.ndarray]], sizes: dict[str, int], components: int) -> dict[str, np.ndarray]:
    """Each key's leading principal components, scaled to deviation 1, from the sums of the centred vectors' products."""

    def make(batch: pa.RecordBatch) -> Sums:
        return {key: (c := v - spread[key][0]).T @ c for key, _, v in by_key(batch)}

    out = {}
    for key, gram in tree_sums(rows.select("key", "v"), make).items():
        d = len(spread[key][0])
        if d > WIDEST:
            raise ValueError(f"principal components of {d} dimensions are over the limit of {WIDEST}")
        values, vectors = np.linalg.eigh(gram.reshape(d, d))
        order = np.argsort(values)[::-1][: min(components, sizes[key] - 1, d)]
        std = np.sqrt(np.maximum(values[order], 0) / sizes[key])
        out[key] = vectors[:, order] / np.where(std > 1e-9 * max(std.max(initial=0), 1e-30), std, 1.0)
    return out


def leave_one_out(df: DataFrame, key: str, vec: str, positive: str, components: int | None = 50, c: float = 0.01, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """ST11 / ST16 / SMP9: ((key, accuracy, hits, n), (key, place, mean_coef)) of logistic probes of a boolean column,
    each row's made without it. Inputs are scaled over the whole group, after projection on ``components``
    principal components unless that is None; coefficients are means over all refits, by place of the input. Groups of
    fewer than three rows or of one class have NULL accuracy and no coefficients; a class's only row is a miss. Rows
    without class or vector don't count. The tables behind the result belong to ``scratch``."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark)
    kind = df.schema[key].dataType.simpleString()
    named = F.coalesce(F.col(key).cast("string"), F.lit("\0null"))
    rows = df.select(named.alias("key"), F.col(positive).cast("boolean").cast("int").cast("string").alias("y"), F.col(vec).cast("array<double>").alias("v")).where("y is not null and v is not null")
    counts: dict[str, dict[str, int]] = {}
    for r in rows.groupBy("key", "y").agg(F.count("*").alias("n")).collect():  # keys are layers or folds: two rows each
        counts.setdefault(r.key, {})[r.y] = r.n
    fine = [k for k, n in counts.items() if len(n) == 2 and sum(n.values()) >= 3]
    sizes = {k: sum(n.values()) for k, n in counts.items()}
    used = rows.where(F.col("key").isin(fine))
    models: dict[str, Model] = {}
    if fine:
        spread = moments(used)
        into = projections(used, spread, sizes, components) if components else {k: 1 / std for k, (_, std) in spread.items()}
        models = fit(used, {k: Model(["0", "1"], spread[k][0], into[k], 1 / c) for k in fine})
    hits, coefs = _refits(used, models, counts, scratch)
    every = spark.createDataFrame([(k, n) for k, n in sizes.items()], "key string, n bigint")
    found = every.join(hits, "key", "left")
    back = F.when(F.col("key") != "\0null", F.col("key")).cast(kind).alias(key)
    return found.select(back, (F.col("hits") / F.col("n")).alias("accuracy"), "hits", "n"), coefs.select(back, "place", "mean_coef")


def ranked_coefficients(coefs: DataFrame, key: str, most: int = 20) -> DataFrame:
    """ST16: the inputs of largest mean coefficient, either sign; the later place first on ties."""
    order = Window.partitionBy(key).orderBy(F.abs("mean_coef").desc(), F.col("place").desc())
    return coefs.select(key, "place", F.abs("mean_coef").alias("mean_abs_coef"), "mean_coef", F.row_number().over(order).alias("rank")).where(F.col("rank") <= most)


def pairs(x: np.ndarray) -> np.ndarray:
    """The products of every two columns, each pair once."""
    a, b = np.triu_indices(x.shape[1])
    return x[:, a] * x[:, b]


class Plane:
    """A fitted probe of two classes as one weight vector, with what the whole group's rows add up to there: gradient,
    curvature, products of inputs and, if it is not too large, the third derivatives. ``lever`` is the group's
    greatest x' inverse x."""

    def __init__(self, model: Model, sums: np.ndarray, n: dict[str, int]):
        self.model, self.counts = model, n
        d = model.size
        self.w = model.w[1] - model.w[0]
        self.ridge = np.append(np.full(d - 1, model.ridge), 0.0)
        self.slope, self.curvature, self.gram = sums[:d], sums[d : d + d * d].reshape(d, d), sums[d + d * d : d + 2 * d * d].reshape(d, d)
        self.third = sums[d + 2 * d * d :].reshape(-1, d) if len(sums) > d + 2 * d * d else None
        self.held = self.curvature + np.diag(self.ridge + 1e-9)
        self.inverse = np.linalg.inv(self.held)
        self.lever = np.inf

    @staticmethod
    def sums(model: Model, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = model.chances(x, model.w)[:, 1]
        a = n * p * (1 - p)
        out = [(n * (p - y)) @ x, ((x * a[:, None]).T @ x).ravel(), ((x * n[:, None]).T @ x).ravel()]
        if model.size <= THIRD:
            cubes = 0.0
            for i in range(0, len(x), ROWS):
                part = x[i : i + ROWS]
                cubes = cubes + pairs(part).T @ (part * (a * (1 - 2 * p))[i : i + ROWS, None])
            out.append(cubes.ravel())
        return np.concatenate(out)

    def expanded(self, w: np.ndarray) -> np.ndarray:
        """The gradient over all rows at each refit's point, to the second order from the whole fit."""
        d = w - self.w
        a, b = np.triu_indices(d.shape[1])
        return self.slope + d @ self.curvature + (pairs(d) * np.where(a == b, 0.5, 1.0)) @ self.third

    def remainder(self, w: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The most that what ``expanded`` leaves out moves a weight: its terms are at most |x d|^3 / 48 times the row
        (a chance's third derivative is at most 1/8), and |x d|, |inverse x| are bounded by ``lever``."""
        d = w - self.w
        far = np.sqrt(np.maximum(((d @ self.held) * d).sum(axis=1), 0))
        own = np.maximum(1 - (self.chance(x @ self.w) * (1 - self.chance(x @ self.w))) * ((x @ self.inverse) * x).sum(axis=1), 1e-12)
        return self.lever * far * np.sqrt(np.diag(self.inverse).max()) * np.maximum(((d @ self.gram) * d).sum(axis=1), 0) / 48 / own

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, how far each may still move) of refits by expanded gradients."""
        w = self.first(x, y)
        if self.third is None:
            return w, np.full(len(y), 1.0)
        step = np.full(w.shape, np.inf)
        for _ in range(MOST):
            step = self.downdated(x, self.left_out(w, x, y, self.expanded(w)))
            step *= np.minimum(1, 5 / np.maximum(np.abs(step).max(axis=1), 1e-30))[:, None]
            w = w - step
            if np.abs(step).max() < TOLERANCE / 100:
                break
        moved = np.abs(step).max(axis=1) + self.remainder(w, x)
        lost = ~(moved < 0.1)  # too far for an expansion
        w[lost] = self.first(x[lost], y[lost])
        return w, np.where(lost, 1.0, moved)

    def chance(self, s: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(s, -500, 500)))

    def downdated(self, x: np.ndarray, g: np.ndarray) -> np.ndarray:
        """(curvature without row i)^-1 g_i, for each row: Sherman and Morrison."""
        p = self.chance(x @ self.w)
        hx, hg = x @ self.inverse, g @ self.inverse
        a = p * (1 - p)
        return hg + hx * (a * (hx * g).sum(axis=1) / np.maximum(1 - a * (hx * x).sum(axis=1), 1e-12))[:, None]

    def first(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.w + self.downdated(x, (self.chance(x @ self.w) - y)[:, None] * x)

    def gradient(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A row for each refit: the sum over the given rows."""
        return ((self.chance(w @ x.T) - y) * n) @ x

    def left_out(self, w: np.ndarray, x: np.ndarray, y: np.ndarray, whole: np.ndarray) -> np.ndarray:
        """The gradient of each refit's own loss, from that over all rows."""
        own = (self.chance((w * x).sum(axis=1)) - y)[:, None] * x
        return whole - own + self.ridge * w

    def alone(self, y: np.ndarray) -> np.ndarray:
        """Rows that are their class's only one: what is left has one class and no probe."""
        single = [int(k) for k, n in self.counts.items() if n == 1]
        return np.isin(y, single)


def _planes(rows: DataFrame, models: dict[str, Model], counts: dict) -> dict[str, Plane]:
    """From ``rows`` (key, y, v, n), each input once."""

    def make(batch: pa.RecordBatch) -> Sums:
        y, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "n"))
        return {key: Plane.sums(models[key], models[key].inputs(v), y[at], n[at]) for key, at, v in by_key(batch)}

    planes = {k: Plane(models[k], s, counts[k]) for k, s in tree_sums(rows, make).items()}

    def levers(batch: pa.RecordBatch) -> Sums:
        return {key: np.array([(((x := models[key].inputs(v)) @ inverses[key]) * x).sum(axis=1).max()]) for key, _, v in by_key(batch)}

    inverses = {k: p.inverse for k, p in planes.items()}
    for k, s in tree_sums(rows.select("key", "v"), levers, np.maximum).items():
        planes[k].lever = float(s[0])
    return planes


def _read(x: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(-1, columns)


SHAPE = "key string, chunk int, x binary, y binary, n binary, w binary, moved double"


def _refits(used: DataFrame, models: dict[str, Model], counts: dict, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(key, hits) and (key, place, mean_coef)."""
    spark = used.sparkSession
    worker_path(spark)
    rows = scratch.settle(used.groupBy("key", "y", "v").agg(F.count("*").alias("n")).select("key", F.col("y").cast("int").alias("y"), "v", "n"), "left-out-rows")
    different = {r.key: r.n for r in rows.groupBy("key").agg(F.count("*").alias("n")).collect()} if models else {}
    planes = spark.sparkContext.broadcast(_planes(rows, models, counts) if models else {})

    # chunks of a group's rows: as many as its size asks for, at a hash of the row
    many = F.create_map(*[F.lit(v) for k in models for v in (k, -(-different[k] * 2 // CHUNK))]) if models else F.create_map().cast("map<string,int>")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("v", "y"), F.try_element_at(many, F.col("key"))).cast("int"))

    def chunked(frame: pd.DataFrame) -> pd.DataFrame:
        key, chunk = frame["key"].iloc[0], int(frame["chunk"].iloc[0])
        plane = planes.value[key]
        x, y, n = plane.model.inputs(np.stack(frame["v"].to_list())), frame["y"].astype(float).to_numpy(), frame["n"].astype(float).to_numpy()
        if len(y) == different[key]:  # a small group
            w, moved, c = plane.first(x, y), np.zeros(len(y)), 1 / plane.model.ridge
            for i in np.flatnonzero(~plane.alone(y)):
                w[i] = fit_binary(x[:, :-1], y, c, w[i], n=n - (np.arange(len(y)) == i))
        else:
            w, moved = plane.near(x, y)
            moved[plane.alone(y)] = 0
        parts = [(chunk, moved <= TOLERANCE), (-1 - chunk, moved > TOLERANCE)]
        return pd.DataFrame([{"key": key, "chunk": at, "x": x[of].tobytes(), "y": y[of].tobytes(), "n": n[of].tobytes(), "w": w[of].tobytes(), "moved": float(moved[of].max())} for at, of in parts if of.any()])

    every = scratch.settle(dealt.groupBy("key", "chunk").applyInPandas(chunked, SHAPE), "left-out-chunks")
    chunks = every.select(F.col("key").alias("other"), F.col("chunk").alias("slot"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("n").alias("on"))
    blocks = _open(every, scratch)
    for _ in range(MOST):
        if blocks.where(F.col("moved") > TOLERANCE).isEmpty():
            break
        blocks = scratch.settle(_step(blocks, chunks, planes), "left-out-steps")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, sums, fits = [], [], []
            for key, x, y, n, w in zip(*[batch.column(c).to_pylist() for c in ("key", "x", "y", "n", "w")], strict=True):
                plane = planes.value[key]
                x, y, n, w = _read(x, plane.model.size), np.frombuffer(y), np.frombuffer(n), _read(w, plane.model.size)
                fit_ = ~plane.alone(y)
                hits.append(int((n * (((x * w).sum(axis=1) > 0) == (y > 0)))[fit_].sum()))
                sums.append((n[fit_] @ w[fit_, :-1]).tolist())
                fits.append(int(n[fit_].sum()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(hits, pa.int64()), pa.array(sums, pa.list_(pa.float64())), pa.array(fits, pa.int64())], ["key", "hits", "sums", "fits"])

    ended = every.where("chunk >= 0").unionByName(blocks)
    ended = scratch.settle(ended.mapInArrow(finish, "key string, hits bigint, sums array<double>, fits bigint"), "left-out-sums")
    hits = ended.groupBy("key").agg(F.sum("hits").alias("hits"))
    total = ended.groupBy("key").agg(F.sum("fits").alias("fits"))
    coefs = ended.select("key", F.posexplode("sums").alias("place", "s")).groupBy("key", "place").agg(F.sum("s").alias("s")).join(total, "key")
    return hits, coefs.select("key", "place", (F.col("s") / F.col("fits")).alias("mean_coef"))


def _open(every: DataFrame, scratch: Scratch) -> DataFrame:
    """The refits that go on to exact gradients, in as few blocks as they fill."""
    left = every.where("chunk < 0")
    size = F.length("y") / 8
    many = left.groupBy("key").agg(F.ceil(F.sum(size) / (CHUNK // 2)).alias("many"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        both = {c: [b"".join(frame[c])] for c in ("x", "y", "n", "w")}
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "chunk": [frame["chunk"].iloc[0]], **both, "moved": [frame["moved"].max()]})

    placed = left.join(F.broadcast(many), "key").withColumn("chunk", F.pmod(F.xxhash64("chunk"), "many").cast("int"))  # a row for each key
    return scratch.settle(placed.drop("many").groupBy("key", "chunk").applyInPandas(packed, SHAPE), "left-out-open")


def _step(blocks: DataFrame, chunks: DataFrame, planes) -> DataFrame:
    """One step of every refit: gradients of blocks over chunks, summed in two rounds, then the blocks move."""

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for key, w, x, y, n in zip(*[batch.column(c).to_pylist() for c in ("key", "w", "ox", "oy", "on")], strict=True):
                plane = planes.value[key]
                sums.append(plane.gradient(_read(w, plane.model.size), _read(x, plane.model.size), np.frombuffer(y), np.frombuffer(n)).tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "chunk", "slot")], pa.array(sums, pa.binary())], ["key", "chunk", "slot", "g"])

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(g) for g in frame["g"])
        return pd.DataFrame({"key": [frame["key"].iloc[0]], "chunk": [frame["chunk"].iloc[0]], "slot": [frame["slot"].iloc[0]], "g": [total.tobytes()]})

    def moved(block: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        b = block.iloc[0]
        if not len(parts):
            return block
        plane = planes.value[b["key"]]
        x, y, w = _read(b["x"], plane.model.size), np.frombuffer(b["y"]), _read(b["w"], plane.model.size)
        whole = _read(sum(np.frombuffer(g) for g in parts["g"]).tobytes(), plane.model.size)
        step = plane.downdated(x, plane.left_out(w, x, y, whole))
        step[plane.alone(y)] = 0
        # far from the whole fit the curvature differs: a bounded step still goes down
        step *= np.minimum(1, 5 / np.maximum(np.abs(step).max(axis=1), 1e-30))[:, None]
        return block.assign(w=[(w - step).tobytes()], moved=[float(np.abs(step).max(initial=0))])

    open_ = blocks.where(F.col("moved") > TOLERANCE)
    pairs = open_.select("key", "chunk", "w").join(chunks, F.col("key") == F.col("other")).select("key", "chunk", "w", F.pmod("slot", F.lit(SLOTS)).alias("slot"), "ox", "oy", "on")
    small = pairs.sparkSession
    had = small.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    small.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")  # rows are blocks
    try:
        partial = pairs.mapInArrow(against, "key string, chunk int, slot int, g binary")
        summed = partial.groupBy("key", "chunk", "slot").applyInPandas(added, "key string, chunk int, slot int, g binary")
        return blocks.groupBy("key", "chunk").cogroup(summed.groupBy("key", "chunk")).applyInPandas(moved, SHAPE)
    finally:
        small.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", had)

"""Toxicity by weak supervision.

1. Features (whole words, and patterns: the first three to five letters of a
   word) that labelled toxic documents have far more often than clean ones are
   mined by Spark from a bounded sample of labelled documents.
2. Every mined feature is a voter: a lexicon entry or a pattern, which votes toxic
   where a document has it and abstains elsewhere. The given label is one more,
   noisy voter: how far it is to be trusted is estimated like the others' accuracy,
   and ``MOST_TRUST`` at most.
3. A generative label model estimates, by EM from the voters' agreement and the share
   of toxic documents, how often each voter votes in toxic and in clean documents
   (its accuracy), and which voters go together within a class (their correlations),
   so that voters which repeat each other don't count twice. Each document of the
   sample gets a posterior label, which may contradict the given one.
4. A linear (logistic) classifier over the mined features is trained on those
   posteriors and scores every document.

The sample holds at most ``PER_CLASS`` documents of either label, taken in order
of a hash of the id; more than that adds little to lists of ``FEATURES`` entries,
which bound the classifier. Of copies with one label (texts equal but for case and
white space, which have the same features) one is taken, since copies would pass
for independent evidence; they go before the limit. The numbers of rows trained on
are logged.

Defined results: null and empty texts score like a text without any feature. Texts
of any length are scored whole, a batch at a time. Twin rows have the same score;
ties between features go to the one that sorts first. A document labelled twice
counts as toxic if any label says so. Without usable labels of both classes, or
without a feature that tells them apart, every score is 0.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import fields, map_batches
from pairloom.session import settle

log = logging.getLogger(__name__)

PER_CLASS = 6000
FEATURES = 1000
CACHE = 100_000  # words whose features a task remembers
LEAST_DOCS, LEAST_ODDS = 4, 6.0
THRESHOLD = 0.7
LEAST_GAIN = 2.0  # a voter votes at least so many times as often in toxic documents: it was mined to
MOST_TRUST = 0.95
RIDGE = 1.0  # of all rows together, so its weight falls as rows come
EDGES = ".,;:!?'\"()[]{}#*$%&|<>-_/"
PREFIXES = (3, 4, 5)


def word_features(word: str) -> list[str]:
    """A word's lexicon entry and its patterns; the first character tells the kind."""
    return ["w" + word, *[f"{n}{word[:n]}" for n in PREFIXES if len(word) > n]] if word else []


def document_features(text: str | None) -> set[str]:
    words = {w.strip(EDGES) for w in set((text or "").lower().split())}
    return {f for w in words for f in word_features(w)}


def training_sample(docs: DataFrame, labels: DataFrame, allowed: Column, per_class: int = PER_CLASS) -> DataFrame:
    """(text, toxic): at most ``per_class`` documents of either label."""
    labelled = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & allowed)
    chosen = labelled.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id"), F.col("k1"), F.col("k2")]
    usable = fields(docs, "doc_id", "text").where("text is not null")
    plain = F.trim(F.regexp_replace(F.lower("text"), r"\s+", " "))
    k1, k2 = F.xxhash64(plain), F.xxhash64(F.lit("second"), plain)
    keyed = usable.select("doc_id", k1.alias("k1"), k2.alias("k2")).join(chosen, "doc_id")  # no text is shuffled
    first = F.min(F.struct(F.xxhash64("doc_id", F.lit(7)).alias("h"), "doc_id")).alias("first")
    single = settle(keyed.groupBy("toxic", "k1", "k2").agg(first).select("toxic", "k1", "k2", F.col("first.doc_id").alias("doc_id")), "toxic-single")
    # top-n of each class: no task holds more than its own n best. At most 2 * per_class ids reach the broadcast
    picked = None
    for label in (0, 1):
        part = single.where(F.col("toxic") == label).orderBy(*order).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    kept = usable.join(F.broadcast(picked), "doc_id").where((k1 == F.col("k1")) & (k2 == F.col("k2")))
    return kept.dropDuplicates(["doc_id", "k1", "k2"]).select("text", "toxic")


def mine_features(sample: DataFrame, n_toxic: int, n_clean: int, most: int = FEATURES) -> list[str]:
    """Features by their log odds times the root of their support, strongest first."""

    def run(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, 200):
            part, counts = batch.slice(start, 200), {}
            for text, toxic in zip(part.column("text"), part.column("toxic"), strict=True):
                t = toxic.as_py()
                for f in document_features(text.as_py()):
                    pair = counts.setdefault(f, [0, 0])
                    pair[t] += 1
            clean, tox = zip(*counts.values(), strict=True) if counts else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(tox, pa.int64()), pa.array(clean, pa.int64())], ["feature", "toxic", "clean"])

    totals = map_batches(sample, run, "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = ((F.col("toxic") + 0.5) / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    strong = totals.withColumn("odds", odds).where((F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= LEAST_ODDS))
    best = strong.orderBy((F.log("odds") * F.sqrt("toxic")).desc(), "feature").limit(most)
    return [r.feature for r in best.select("feature").collect()]


def feature_rows(sample: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each document, row and column of each feature present): bounded by the sample."""
    at = {f: i for i, f in enumerate(features)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hits = [sorted(at[f] for f in document_features(t.as_py()) if f in at) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(hits, pa.list_(pa.int32()))], ["toxic", "hits"])

    rows = map_batches(sample, run, "toxic int, hits array<int>").collect()
    rows.sort(key=lambda r: (r.toxic, r.hits))  # independent of the order of tasks
    label = np.array([r.toxic for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r.hits) for r in rows])
    return label, row, np.array([h for r in rows for h in r.hits], np.int64)


def label_model(n: int, row: np.ndarray, column: np.ndarray, given: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of the toxic class for ``n`` documents from votes (``row``, ``column``: document and
    voter) and the given labels. Each voter has a rate of votes in either class; its evidence, the log
    ratio of the rates, is divided among the voters it is correlated with inside the classes. The
    given label is a voter of limited accuracy, estimated too. EM begins with the documents of the
    most votes as toxic ones and goes on until the posteriors settle."""
    m, share = int(column.max(initial=-1)) + 1, float(np.clip(given.mean(), 1e-3, 0.999))
    count = np.bincount(row, minlength=n)
    voted = np.flatnonzero(count)
    votes = np.zeros((len(voted), m), np.float32)  # documents without a vote only count in sums
    votes[np.searchsorted(voted, row), column] = 1
    silent = (count == 0).astype(float)
    post = np.where(count >= max(1.0, np.quantile(count, 1 - share)), 0.9, 0.1 * share)
    alike, prior = np.ones(m), np.log(share / (1 - share))
    for k in range(rounds):
        rate, quiet, labels, joint = {}, {}, {}, np.zeros((m, m), np.float32)
        for toxic, part in ((True, post), (False, 1 - post)):
            size = part.sum()
            rate[toxic] = (part[voted] @ votes + 0.5) / (size + 1)
            quiet[toxic], labels[toxic] = (part @ silent + 0.5) / (size + 1), (part @ given + 0.5) / (size + 1)
            if k in (0, 1, 2, 5, 10, 20):  # correlations settle sooner than rates
                r = rate[toxic].astype(np.float32)
                cov = (votes * part[voted, None].astype(np.float32)).T @ votes / max(size, 1e-9) - np.outer(r, r)
                spread = np.sqrt(np.maximum(r * (1 - r), 1e-9))
                joint += part.mean() * np.clip(cov / np.outer(spread, spread), 0, 1)
        if joint.any():
            np.fill_diagonal(joint, 0)
            alike = 1 + joint.sum(axis=1)
        toxic, clean = np.clip(rate[True], 2e-4, 0.995), np.clip(np.minimum(rate[False], rate[True] / LEAST_GAIN), 1e-4, 0.99)
        hit, false = min(labels[True], MOST_TRUST), max(labels[False], 1 - MOST_TRUST)
        logit = prior + silent * np.log(quiet[True] / quiet[False]) + np.where(given == 1, np.log(hit / false), np.log((1 - hit) / (1 - false)))
        logit[voted] += votes @ (np.log(toxic / clean) / alike)
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done = np.abs(new - post).max() < 1e-5
        post = new
        if done:
            break
    return post


def fit_linear(post: np.ndarray, row: np.ndarray, column: np.ndarray, width: int, ridge: float = RIDGE, steps: int = 30) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing the same, by Newton's method. The
    matrix is dense: at most 2 * PER_CLASS rows and FEATURES columns."""
    n, share = len(post), np.clip(post.mean(), 1e-3, 1 - 1e-3)
    heavy = (np.where(post > 0.5, 0.5 / share, 0.5 / (1 - share)) / n)[:, None]
    x = np.zeros((n, width + 1), np.float32)
    x[row, column] = 1
    x[:, -1] = 1
    w, penalty = np.zeros(width + 1), np.append(np.full(width, ridge / n), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))[:, None]
        gradient = (x.T @ (heavy * (p - post[:, None]))).ravel() + penalty * w
        hessian = (x * (heavy * p * (1 - p)).astype(np.float32)).T @ x + np.diag(penalty + 1e-9)
        move = np.linalg.solve(hessian.astype(np.float64), gradient)
        w -= move * min(1.0, 4.0 / max(np.abs(move).max(), 1e-9))  # steps of bounded length
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, allowed: Column) -> tuple[dict[str, float], float] | None:
    """(weight of each feature, intercept), or None without labels of both classes."""
    # the limits leave one partition; the sample's mining is worth more tasks
    sample = settle(training_sample(docs, labels, allowed).repartition(12, F.xxhash64("text")), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    log.info("trained on %d toxic and %d clean rows", sizes.get(1, 0), sizes.get(0, 0))
    if len(sizes) < 2:
        return None
    features = mine_features(sample, sizes[1], sizes[0])
    if not features:
        return None
    label, row, column = feature_rows(sample, features)
    post = label_model(len(label), row, column, label.astype(float))
    weights, intercept = fit_linear(post, row, column, len(features))
    return dict(zip(features, weights.tolist(), strict=True)), intercept


def score(docs: DataFrame, model: tuple[dict[str, float], float] | None, keep: tuple[str, ...], name: str = "score") -> DataFrame:
    """The kept columns and the score under ``name``; every document, whole texts, no shuffle."""
    weights, intercept = model or ({}, 0.0)
    known: dict[str, tuple[str, ...]] = {}

    def one(text: str | None) -> float:
        if model is None:
            return 0.0
        hits: set[str] = set()
        for word in set((text or "").lower().split()):
            found = known.get(word)
            if found is None:
                if len(known) > CACHE:
                    known.clear()
                found = known[word] = tuple(f for f in word_features(word.strip(EDGES)) if f in weights)
            hits.update(found)
        return float(1 / (1 + np.exp(-np.clip(intercept + sum(weights[h] for h in sorted(hits)), -30, 30))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([one(t.as_py()) for t in batch.column("text")], pa.float64())
        return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [made], [*keep, name])

    kept = docs.select(*dict.fromkeys([*keep, "text"]))
    schema = T.StructType([kept.schema[c] for c in keep] + [T.StructField(name, T.DoubleType())])
    return map_batches(kept, run, schema)


def held_out(column: str = "doc_id") -> Column:
    """Rows whose labels aren't learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    model = train(docs, labels, ~held_out())
    scored = score(docs.select("doc_id", "text", held_out().alias("held_out")), model, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))

"""A cleaning pipeline over ``documents``: what each stage keeps is written as Parquet and read
again by the next one.

toxicity          drops documents whose score reaches the threshold
line_dedup        cuts later occurrences of three-line windows; a document of which
                  no line is left is a copy of lines kept elsewhere and goes
near_dedup        keeps one document of each group of near-duplicates (five-word
                  shingles, similarity 0.8)
decontamination   drops documents that hold a benchmark item
sentencepiece     encodes what is left, and decodes it as a check: doc_id, n_tokens, ids and
                  decoded_sha256; the other columns end here

All stages but the last keep the columns of ``documents`` and any others. A null text
is no toxic one, has no lines, is a near-duplicate of nothing, holds no benchmark item
and has no tokens; an empty text likewise. Of twin rows (equal id and text) one
reaches the end. Texts of any length are taken whole; an empty table stays one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontamination, line_dedup, near_duplicates, sentencepiece_codec, toxicity
from pairloom.llm.common import fresh, map_batches
from pairloom.session import release, shared_path, swept, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    (score,) = fresh(docs.columns, "score")
    scored = toxicity.score(docs, model, tuple(docs.columns), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lines, removed = fresh(docs.columns, "n_lines", "n_removed")
    out = line_dedup.remove_repeats(docs, counts=(lines, removed)).where((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded_sha256."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = sentencepiece_codec.codec_at(None)
        ids, digests = [], []
        for text in batch.column("text"):
            own = codec.encode(text.as_py() or "")[0]
            ids.append(own.astype(np.int32))
            digests.append(hashlib.sha256(codec.decode(own.tolist()).encode()).hexdigest())
        counts = np.array([len(i) for i in ids], np.int64)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), lists, pa.array(digests, pa.string())], ["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_tokens bigint, ids array<int>, decoded_sha256 string")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: SQL has no SentencePiece and no trained classifier; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            release(spark, before)
        before = path
    return docs

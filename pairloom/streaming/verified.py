"""A log of committed batches that notices damage: every marker has the number of rows and a digest of the batch.

Both are counted while the batch is written. Before a restart uses the log, the batches are read and counted again;
one that differs or cannot be read is set aside, and its keys are done again.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.joins import not_done
from pairloom.sources.writers import _fs
from pairloom.streaming import resume


UNREADABLE = ("FAILED_READ_FILE", "CANNOT_READ_FILE", "PATH_NOT_FOUND", "is not a Parquet file")  # codes and words of Spark's errors


def digest_of(columns: list[str]) -> list[Column]:
    """Rows and the sum of their hashes: whatever their order and files."""
    hashes = F.xxhash64(*[F.col(f"`{c}`") for c in columns]).cast("decimal(38,0)")
    return [F.count("*").alias("rows"), F.coalesce(F.sum(hashes), F.lit(0)).cast("string").alias("digest")]


class VerifiedLog:
    """Batches under ``path`` of one schema; ``keys`` name what is done."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self.columns = self.schema.names

    def commit(self, rows: DataFrame) -> str:
        """Append a batch; its digest comes from the same pass that writes it."""
        seen = Observation()
        given = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema])
        name = resume.commit(given.observe(seen, *digest_of(self.columns)), self.path, {})
        note = {"rows": seen.get["rows"], "digest": seen.get["digest"]}
        resume.write_text(self.spark, f"{self.path}/_done/{name}.json", resume.json.dumps(note, sort_keys=True))
        return name

    def _count(self, name: str) -> dict | None:
        """What a batch holds now; None if it cannot be read."""
        try:
            # pages are held against their own checksums, too
            got = self.spark.read.schema(self.schema).option("parquet.page.verify-checksum.enabled", "true").parquet(f"{self.path}/batch={name}").agg(*digest_of(self.columns)).first()
        except (PySparkException, Py4JJavaError) as error:
            if any(code in str(error) for code in UNREADABLE):
                return None
            raise  # a lost executor or a full disk is no damage to the batch
        return {"rows": got.rows, "digest": got.digest}

    def damaged(self) -> list[str]:
        """STM2: batches whose rows aren't those that were committed. A marker without a digest is of a run that was lost
        between batch and digest: its batch counts as damaged, too."""
        return [name for name, note in sorted(resume.committed(self.spark, self.path).items()) if self._count(name) != note]

    def set_aside(self, name: str) -> str:
        """Move a batch out of the log, its marker first, so it never counts half; returns where it lies now."""
        fs, marker, jvm = _fs(self.spark, f"{self.path}/_done/{name}.json")
        aside = f"{self.path}/_damaged/{name}"
        at = jvm.org.apache.hadoop.fs.Path
        fs.mkdirs(at(f"{self.path}/_damaged"))
        fs.rename(marker, at(f"{aside}.json"))
        if fs.exists(at(f"{self.path}/batch={name}")):
            fs.rename(at(f"{self.path}/batch={name}"), at(aside))
        return aside

    def read(self) -> DataFrame:
        """A row for each key that is done."""
        return resume.finished(self.spark, self.path, self.schema, self.keys)

    def resume(self, todo: DataFrame, work: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """STM1-3: set damaged batches aside, then do and commit what isn't done: {damaged, done}."""
        bad = self.damaged()
        for name in bad:
            self.set_aside(name)
        schema = ", ".join(f"`{c}` {todo.schema[c].dataType.simpleString()}" for c in self.keys)
        before = self.read().count()
        self.commit(work(not_done(todo, resume.finished(self.spark, self.path, schema, self.keys), self.keys)))
        return {"damaged": len(bad), "done": self.read().count() - before}


def flip_byte(spark: SparkSession, folder: str, place: int | None = None) -> str:
    """Damage one byte in the middle of the largest file of a folder (a rehearsal's helper); returns its path."""
    files = spark.read.format("binaryFile").load(folder).orderBy(F.col("length").desc(), "path").limit(1)
    file = files.first()
    content = bytearray(file.content)
    content[len(content) // 3 if place is None else place] ^= 0xFF
    resume.write_text(spark, file.path, bytes(content))
    return file.path


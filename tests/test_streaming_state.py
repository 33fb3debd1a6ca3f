"""Streams with state over restarts, and logs that notice damage."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from pairloom.streaming import keyed, resume, verified


def test_each_key_once_over_restarts(spark, tmp_path):
    """Failure in the second batch, restart, later files with old and new keys."""
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def put(rows):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.mode("append").parquet(source)

    seen = []

    def work(batch):
        seen.append(sorted((r.k for r in batch.collect()), key=str))
        if len(seen) == 2:
            raise RuntimeError("on the way")
        return batch

    def start():
        return keyed.stream_once(spark, source, "k long, v string", sink, state, work, ["k"], files=1)

    put([(1, "a"), (2, "b"), (1, "c")])
    put([(2, "d"), (3, "e")])
    with pytest.raises(StreamingQueryException, match="on the way"):
        start().awaitTermination()
    start().awaitTermination()
    put([(3, "f"), (4, "g"), (None, "h")])
    start().awaitTermination()
    start().awaitTermination()  # nothing new
    assert sorted(((r.k is None, r.k) for r in spark.read.parquet(sink).collect()), key=str) == [(False, 1), (False, 2), (False, 3), (False, 4), (True, None)]
    assert seen[:3] == [[1, 2], [3], [3]]


def test_the_state_of_keys_needs_no_python(spark, tmp_path, capsys):
    """a call of Python for each key made a stream of millions of keys too slow."""
    spark.range(3).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "in"))
    keyed.unseen(spark.readStream.schema("k long").parquet(str(tmp_path / "in")), ["k"]).explain()
    plan = capsys.readouterr().out
    assert "StreamingDeduplicate" in plan and "Pandas" not in plan and "Python" not in plan


def log_of(spark, tmp_path):
    return verified.VerifiedLog(spark, str(tmp_path / "log"), "k long, v string", ["k"])


def filled(spark, tmp_path, n=4):
    log = log_of(spark, tmp_path)
    rows = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("value "), "id").alias("v"))
    for i in range(n):
        assert log.resume(rows.where(f"k % {n} = {i}"), lambda df: df) == {"damaged": 0, "done": 100}
    return log, rows


def test_a_flipped_byte_costs_one_batch(spark, tmp_path):
    log, rows = filled(spark, tmp_path)
    assert log.damaged() == []
    names = sorted(resume.committed(spark, log.path))
    files = [f for f in (tmp_path / "log" / f"batch={names[1]}").iterdir() if f.suffix == ".parquet"]
    content = max(files, key=lambda f: f.stat().st_size).read_bytes()
    verified.flip_byte(spark, f"{log.path}/batch={names[1]}", content.index(b"value ") + 3)
    assert log.damaged() == [names[1]]
    assert log.resume(rows, lambda df: df) == {"damaged": 1, "done": 100}
    assert log.read().count() == 400 and (tmp_path / "log" / "_damaged" / names[1]).is_dir()
    assert log.resume(rows, lambda df: df) == {"damaged": 0, "done": 0}


def test_other_damage(spark, tmp_path):
    """A file that is gone, rows that were exchanged, a footer cut off, a folder that is missing."""
    import os
    import shutil

    log, rows = filled(spark, tmp_path)
    a, b, c, d = sorted(resume.committed(spark, log.path))
    folder = lambda n: tmp_path / "log" / f"batch={n}"
    largest = lambda n: max((f for f in folder(n).iterdir() if f.suffix == ".parquet"), key=os.path.getsize)
    largest(a).unlink()
    spark.range(100).select(F.col("id").alias("k"), F.lit("other").alias("v")).write.mode("overwrite").parquet(str(folder(b)))
    content = largest(c).read_bytes()
    for f in folder(c).iterdir():
        if f.name.startswith(".") and f.suffix == ".crc":
            f.unlink()
    largest(c).write_bytes(content[:-9])
    shutil.rmtree(folder(d))
    assert log.damaged() == sorted([a, b, c, d])
    assert log.resume(rows, lambda df: df) == {"damaged": 4, "done": 400}
    assert log.read().where("v = 'other'").count() == 0


def test_an_empty_log(spark, tmp_path):
    log = log_of(spark, tmp_path)
    assert log.damaged() == [] and log.read().count() == 0
    assert log.resume(spark.range(0).select(F.col("id").alias("k"), F.lit("x").alias("v")), lambda df: df) == {"damaged": 0, "done": 0}
    assert log.damaged() == []

"""Sources, sinks, resumable state and the boundary to services."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.sources import readers, writers
from pairloom.streaming import external, resume


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_records_of_several_files(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps([{"question_id": "q1", "original": {"question": "x", "options": {"A": "1"}}, "counterfactuals": {"variants": [{"intervention_type": "sex", "text": "t"}]}}]))
    b = put(tmp_path / "b.json", json.dumps([{"question_id": "q1", "counterfactuals": {"variants": {"age": {"young": {"text": "u"}}}}}]))
    rows = sorted((r.file_idx, r.question_id, [v.intervention_type for v in r.variants]) for r in readers.read_records(spark, [a, b]).collect())
    assert rows == [(0, "q1", ["sex"]), (1, "q1", ["age"])]


def test_list_or_object(spark, tmp_path):
    a, b, c = put(tmp_path / "l.json", '[{"x": 1}, {"x": 2}]'), put(tmp_path / "o.json", '{"k": {"x": 3}}'), put(tmp_path / "s.json", '"no"')
    assert [r.x for r in readers.records_of(spark, a, "struct<x:int>").collect()] == [1, 2]
    assert [r.x for r in readers.records_of(spark, b, "struct<x:int>").collect()] == [3]
    with pytest.raises(Exception, match="neither"):
        readers.records_of(spark, c, "struct<x:int>").collect()


def test_text_formats(spark, tmp_path):
    csv = put(tmp_path / "d.csv", "split,v,n\ntrain,1,3\ntest,2,x\n")
    assert [r.v for r in readers.read_csv(spark, csv, "split string, v int, n string", "train").collect()] == [1]
    assert [r.n for r in readers.read_index(spark, csv, ["n"]).orderBy("v").collect()] == [3, None]
    put(tmp_path / "tasks/one/train.tsv", "a\tb\n1\t2\n")
    put(tmp_path / "tasks/two/train.tsv", "a\tb\n3\t4\n")
    got = sorted((r.task_name, r.a) for r in readers.read_task_folders(spark, str(tmp_path / "tasks"), "a int, b int").collect())
    assert got == [("one", 1), ("two", 3)]
    lines = put(tmp_path / "r.jsonl", '{"success": true, "v": 1}\n{"success": false, "v": 2}\n')
    assert [r.v for r in readers.read_jsonl(spark, lines, "success boolean, v int", True).collect()] == [1]
    md = put(tmp_path / "README.md", "# T\nReasoning type: deductive\n")
    assert readers.read_fields(spark, md, {"kind": r"Reasoning type: (\w+)"}).first().kind == "deductive"


def test_npz_as_long_table(spark, tmp_path):
    np.savez(tmp_path / "c.npz", acts=np.arange(12.0).reshape(2, 3, 2), item=np.array(["a", "b"]))
    rows = readers.read_npz(spark, str(tmp_path / "c.npz"), "acts", ["item", "layer", "dim"]).collect()
    assert sorted((r["item"], r["layer"], r["vec"]) for r in rows)[-1] == ("b", "2", [10.0, 11.0])


def test_sharded_store(spark, tmp_path):
    root = str(tmp_path / "store")
    rows = spark.createDataFrame([("original", "q1", 1.0), ("cf", "q1__sex", 2.0)], "kind string, key string, x double")
    writers.write_parquet(rows, f"{root}/results", by=("kind",))
    writers.write_parquet(spark.createDataFrame([("q1__sex",)], "pair_key string"), f"{root}/pair_metadata")
    store = readers.ShardedStore(spark, root)
    assert store.get("cf", "q1__sex").first().x == 2.0 and store.get("cf", "nothing").count() == 0
    assert store.pairs().count() == 1 and store.shards().agg(F.sum("n_keys")).first()[0] == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("k", [1, 2], float("nan"), "long")], "id string, xs array<int>, v double, text string")
    writers.write_csv(df, str(tmp_path / "csv"), drop=("text",), first=("v",))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["v", "id", "xs"]
    writers.write_json(df, str(tmp_path / "json"))
    assert spark.read.schema("v double, id string").json(str(tmp_path / "json")).first().v is None
    writers.write_parquet(spark.range(10), str(tmp_path / "p"), rows_per_file=3)
    assert sum(f.endswith(".parquet") for f in os.listdir(tmp_path / "p")) >= 4
    assert json.loads(writers.grouped_json(df, "id", ["text"]).first().entries) == [{"text": "long"}]
    assert {(r.key, r.value) for r in writers.report(df.select("id"), "s").collect()} == {("id", "k")}
    layers = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0)], "k string, l int, m double")
    assert writers.wide(layers, ["k"], "l", [0, 1], ["m"]).first().asDict() == {"k": "a", "L00_m": 1.0, "L01_m": 2.0}
    writers.write_experiment(str(tmp_path / "exp"), "race", "a1", {"per_pair": layers}, {"n": 1})
    assert spark.read.parquet(str(tmp_path / "exp/family=race/experiment=a1/per_pair")).count() == 2
    scored = spark.createDataFrame([(0, 0.5, "x", "y"), (1, 0.9, "x", "x"), (1, 0.9, "y", "x")], "layer int, s double, t string, g string")
    assert {(r.t, r.x, r.y) for r in writers.confusion_of_best(scored, "layer", "s", "t", "g", ["x", "y"]).collect()} == {("x", 1, 0), ("y", 1, 0)}


def test_versions_fall_back(spark, tmp_path):
    v = writers.Versions(spark, str(tmp_path / "v"))
    assert v.read() is None
    v.write(spark.range(1))
    new = v.write(spark.range(2))
    assert v.read().count() == 2
    for f in os.listdir(tmp_path / "v" / new):
        if f.endswith(".parquet"):
            (tmp_path / "v" / new / f).write_bytes(b"broken")
            (tmp_path / "v" / new / f".{f}.crc").unlink(missing_ok=True)
    assert v.read().count() == 1


def test_resume_is_idempotent(spark, tmp_path):
    path, todo = str(tmp_path / "done"), spark.range(10).withColumnRenamed("id", "k")
    assert resume.resume(spark, todo.where("k < 4"), path, ["k"], lambda df: df.withColumn("v", F.col("k") * 2)) == 4
    assert resume.resume(spark, todo, path, ["k"], lambda df: df.withColumn("v", F.col("k") * 2)) == 10
    assert resume.resume(spark, todo, path, ["k"], lambda df: df.withColumn("v", F.col("k") * 2)) == 10
    other = str(tmp_path / "once")
    resume.append_once(spark, spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), other, ["k"])
    resume.append_once(spark, spark.createDataFrame([(1, "c"), (2, "d")], "k int, v string"), other, ["k"])
    assert spark.read.parquet(other).count() == 2


def test_file_stream_restarts_where_it_stopped(spark, tmp_path):
    source, sink, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.range(5).write.parquet(source)
    run = lambda: resume.stream_files(spark, source, "id long", sink, check, lambda df: df.withColumn("v", F.col("id") + 1), ["id"]).awaitTermination()
    run()
    spark.range(5, 8).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(sink).count() == 8


def test_quarantine_and_scopes(spark, tmp_path):
    path = put(tmp_path / "x.jsonl", '{"a": 1}\n{broken\n')
    good, bad = resume.quarantine(spark.read.schema("a int, _corrupt_record string").json(path).cache())
    assert [r.a for r in good.collect()] == [1] and bad.count() == 1
    assert resume.covers(["all", "final"], ["final"]) and not resume.covers(["final"], ["all"])


def test_windowed_counts(spark, sf):
    from pairloom.session import table

    events = table(spark, sf, "events")
    assert resume.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_external_calls_retry():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return '```json\n{"ok": 1}\n```'

    assert external.call_with_retries(flaky, "p", 3, 0.0) == '{"ok": 1}'
    assert external.call_with_retries(lambda p: "not json", "p", 2, 0.0) is None


def test_external_batches(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, prompt string")
    got = {r.k: r.response for r in external.ask(rows, "k", "prompt", lambda p: '{"p": "' + p + '"}', pause=0.0).collect()}
    assert got == {1: '{"p": "a"}', 2: None}


def test_shards_and_manifest(spark, tmp_path):
    m = resume.write_shards(spark.range(100).coalesce(1), str(tmp_path / "s"), 30, "id")
    assert sorted((r.n, r.first) for r in m.collect()) == [(10, 90), (30, 0), (30, 30), (30, 60)]


def test_shards_of_a_table_of_one_task_are_written_by_several(spark, tmp_path):
    """one task wrote every file. Tasks number their files' names."""
    m = resume.write_shards(spark.range(1000).coalesce(1), str(tmp_path / "s"), 30, "id").collect()
    assert sum(r.n for r in m) == 1000 and max(r.n for r in m) <= 30
    assert len({r.file.split("-")[1] for r in m}) == spark.sparkContext.defaultParallelism


def test_observed_counters(spark):
    from pairloom.plans.experiments import key_union, observed

    df, watch = observed(spark.range(10), "c", {"even": F.col("id") % 2 == 0})
    df.collect()
    assert watch.get == {"even": 5}
    assert key_union([spark.range(1), spark.range(1).withColumn("z", F.lit(1))], ["z", "q"]) == ["z", "id"]


def test_an_uncommitted_batch_does_not_count(spark, tmp_path):
    path = str(tmp_path / "log")
    resume.commit(spark.range(3).withColumnRenamed("id", "k"), path)
    spark.range(3, 9).withColumnRenamed("id", "k").write.parquet(f"{path}/batch=lost")
    assert sorted(r.k for r in resume.finished(spark, path, "k bigint").collect()) == [0, 1, 2]
    assert resume.resume(spark, spark.range(5).withColumnRenamed("id", "k"), path, ["k"], lambda df: df) == 5
    resume.commit(spark.range(3).withColumnRenamed("id", "k"), path)  # another run at the same time
    assert resume.finished(spark, path, "k bigint", ["k"]).count() == 5


def test_old_shards_stay_until_the_new_ones_are_whole(spark, tmp_path):
    root = str(tmp_path / "s")
    resume.write_shards(spark.range(10), root, 4, "id")
    spark.range(99).write.parquet(f"{root}/lost/shards")
    assert resume.read_shards(spark, root).count() == 10


def test_dry_run_stops_at_the_first_failure(spark):
    from pairloom.operators.quality import dry_run

    got = dry_run(spark.range(9), {"a": lambda df: df.withColumn("x", F.lit(1)), "b": lambda df: df.select("nothing"), "c": lambda df: df}, 3)
    assert [(r.step, r.ok, r.rows) for r in got.collect()] == [("a", True, 3), ("b", False, 0)]


def test_a_sweep_leaves_tables_of_other_threads(spark):
    import threading

    from pairloom.session import settle, swept

    kept, gone = [], []
    ready, go = threading.Event(), threading.Event()

    def other():
        go.wait(60)
        kept.append(settle(spark.range(3), "other"))
        ready.set()

    thread = threading.Thread(target=other)
    thread.start()
    with swept(spark):
        gone.append(settle(spark.range(3), "own"))
        with swept(spark):
            gone.append(settle(spark.range(3), "inner"))
        go.set()
        assert ready.wait(60)
    thread.join()
    assert kept[0].count() == 3
    for df in gone:
        with pytest.raises(Exception, match="NOT_EXIST|NOT_FOUND"):
            df.count()

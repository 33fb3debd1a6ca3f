"""Arrays and the store of vectors: slices, look-ups, versions, failures."""

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.sources import array_source as A


def vectors(spark, n=300, shift=0.0):
    rows = [(k, f"q{i:04d}", [float(i) + shift, -float(i), 0.5]) for i in range(n) for k in ("original", "edited")]
    return spark.createDataFrame(rows, "kind string, key string, vec array<double>").repartition(7)


def test_a_cube_is_cut_into_slices(spark, tmp_path):
    rng = np.random.default_rng(0)
    cube = rng.normal(size=(50, 4, 6)).astype(np.float32)
    np.savez(tmp_path / "a.npz", states=cube, pair=np.array([f"p{i}" for i in range(50)]))
    np.savez_compressed(tmp_path / "b.npz", states=cube[:7] * 2)
    reader = A.NpzReader({"path": str(tmp_path), "values": "states", "axes": "pair,layer", "taskBytes": str(4 * 6 * 4 * 20)})
    assert [(os.path.basename(p.path), p.start, p.stop) for p in reader.partitions()] == [("a.npz", 0, 20), ("a.npz", 20, 40), ("a.npz", 40, 50), ("b.npz", 0, 7)]
    got = {(r.pair, r.layer): r.vec for r in A.read_arrays(spark, str(tmp_path), "states", ["pair", "layer"], taskBytes=4 * 6 * 4 * 20).collect()}
    assert len(got) == 57 * 4
    assert got["p33", "2"] == cube[33, 2].astype(float).tolist() and got["6", "3"] == (cube[6, 3] * 2).astype(float).tolist()


def test_a_slice_does_not_read_the_archive(tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(400000.0).reshape(-1, 4))

    class Counted(io.BytesIO):
        seen = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.seen += len(got)
            return got

    member = A.Member(Counted((tmp_path / "a.npz").read_bytes()), "x")
    assert member.read(90000, 90002).tolist() == [[360000.0, 360001.0, 360002.0, 360003.0], [360004.0, 360005.0, 360006.0, 360007.0]]
    assert Counted.seen < 20000


def test_names_choose_slices(spark, tmp_path):
    np.savez(tmp_path / "a.npz", x=np.zeros((40, 2)), k=np.array([f"k{i}" for i in range(40)]))
    options = {"path": str(tmp_path), "values": "x", "axes": "k", "taskBytes": "160"}
    assert len(A.NpzReader(options).partitions()) == 4
    assert [(p.start, p.stop) for p in A.NpzReader(options | {"names": '["k17"]'}).partitions()] == [(10, 20)]
    df = A.read_arrays(spark, str(tmp_path), "x", ["k"], ["k17"], taskBytes=160)
    assert df.count() == 1 and df.rdd.getNumPartitions() == 1
    assert A.read_arrays(spark, str(tmp_path), "x", ["k"], []).count() == 0


def test_pickles_are_refused(tmp_path):
    np.savez(tmp_path / "a.npz", x=np.array([{"a": 1}], object))
    with pytest.raises(ValueError, match="plain"):
        A.NpzReader({"path": str(tmp_path), "values": "x", "axes": "k"}).partitions()


def test_a_look_up_reads_one_file(spark, tmp_path):
    root = str(tmp_path / "store")
    A.write_vectors(vectors(spark), root, rows_per_file=40)
    store = A.read_vectors(spark, root)
    assert {(r.kind, r.key): r.vec for r in store.collect()} == {(r.kind, r.key): r.vec for r in vectors(spark).collect()}
    one = A.read_vectors(spark, root, ["edited"], ["q0123"])
    assert one.rdd.getNumPartitions() == 1 and [r.vec for r in one.collect()] == [[123.0, -123.0, 0.5]]
    assert A.read_vectors(spark, root, keys=["q0003", "q0290", "none"]).count() == 4
    assert A.read_vectors(spark, root, ["original"], low="q0291", high="q0295").count() == 5
    assert A.read_vectors(spark, root, keys=["none"]).count() == 0 and A.read_vectors(spark, root, keys=[]).count() == 0
    # two filters on one loaded table
    a, b = (store.where(f"kind = '{k}'").select("key") for k in ("original", "edited"))
    assert a.join(b, "key").count() == 300
    files = lambda **options: len(A.ShardReader({"path": root} | options).partitions())
    assert files() >= 15 and files(keys='["q0003", "q0004"]', kinds='["original"]') == 1 and files(low="q0291", high="q0295") <= 4


def test_a_failed_job_leaves_the_last_version(spark, tmp_path):
    root = str(tmp_path / "store")
    A.write_vectors(vectors(spark, 20), root)
    before = sorted(os.listdir(root))
    bad = F.udf(lambda k: 1 / 0 if k == "q0013" else k, "string")
    with pytest.raises(Exception, match="division by zero"):
        A.write_vectors(vectors(spark, 20, 5.0).withColumn("key", bad("key")), root)
    assert sorted(os.listdir(root)) == before and A.read_vectors(spark, root, keys=["q0003"]).first().vec[0] == 3.0
    with pytest.raises(Exception, match="must not be null"):
        A.write_vectors(vectors(spark, 3).withColumn("vec", F.lit(None)), root)
    assert sorted(os.listdir(root)) == before


def test_versions_and_appends(spark, tmp_path):
    root = tmp_path / "store"
    for shift in (1.0, 2.0, 3.0):
        A.write_vectors(vectors(spark, 10, shift), str(root))
    names = [v["name"] for v in json.loads((root / "CURRENT").read_text())]
    assert len(names) == 2 and sorted(os.listdir(root)) == sorted(["CURRENT", *names])
    more = spark.createDataFrame([("other", "z", [9.0])], "kind string, key string, vec array<double>")
    A.write_vectors(more, str(root), append=True)
    A.write_vectors(more.withColumn("key", F.lit("y")), str(root), append=True)
    assert A.read_vectors(spark, str(root)).count() == 22
    # a damaged manifest: the version before is read
    current = json.loads((root / "CURRENT").read_text())[0]["name"]
    (root / current / "manifest.json").write_text("[]")
    assert A.read_vectors(spark, str(root)).count() == 21
    A.write_vectors(more.limit(0), str(root))
    assert A.read_vectors(spark, str(root)).count() == 0
    assert A.read_vectors(spark, str(tmp_path / "nothing")).count() == 0

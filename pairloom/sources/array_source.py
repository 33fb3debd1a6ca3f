"""Arrays in NPZ files as Spark data sources, and a versioned, keyed store of vectors made of them.

``npz`` reads a named array of every archive of a folder. Archives are cut along their first axis, so one larger
than a task's share is read by several tasks, each of which seeks to its own rows.

``vector_shards`` is a store of (kind, key, vec). Its writer's tasks write archives of bounded length into a
version's own folder and send what they hold as commit messages; the driver writes these as the version's
manifest and then moves the pointer. A job that fails leaves no manifest, and the version before stays
current. Its reader plans from the manifest: a kind, keys or a range of keys leave only the archives, and the
rows within, that have them.

Look-ups are options of a read and not pushed filters: Spark 4.1 keeps what was pushed with the loaded table, so
that of two filters on it in one plan each would meet the other's rows.

Files are opened by ``pyarrow.fs``, so a path is one on every machine (a shared mount, HDFS, S3).
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pairloom.session import worker_path

TASK_BYTES = 64 << 20  # of an array that one task reads
BATCH_BYTES = 4 << 20
ROWS_PER_FILE = 100_000


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    fs, inside = pafs.FileSystem.from_uri(path)
    return fs, inside.rstrip("/")


def _option(options: dict, name: str, default: int) -> int:
    """Spark hands options over in lower case."""
    return int({k.lower(): v for k, v in options.items()}.get(name.lower(), default))


def _names(options: dict, name: str) -> set[str] | None:
    """An option that is a JSON list of names; None if it isn't given."""
    said = {k.lower(): v for k, v in options.items()}.get(name.lower())
    return None if said is None else set(json.loads(said))


class Member:
    """An array inside an archive, read by rows of its first axis."""

    def __init__(self, file, name: str):
        self.file = file
        with zipfile.ZipFile(file) as archive:
            info = archive.getinfo(f"{name}.npy")
            with archive.open(info) as f:
                version = np.lib.format.read_magic(f)
                self.shape, fortran, self.dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
                self.header = f.tell()
        if fortran and len(self.shape) > 1 or self.dtype.hasobject:
            raise ValueError(f"{name} must be plain numbers or strings, row by row")
        self.info, self.name = info, name
        self.row = int(np.prod(self.shape[1:], dtype=np.int64)) * self.dtype.itemsize

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.shape[0] if stop is None else stop
        skip, size = self.header + start * self.row, (stop - start) * self.row
        if self.info.compress_type == zipfile.ZIP_STORED:
            self.file.seek(self.info.header_offset + 26)
            name, extra = struct.unpack("<HH", self.file.read(4))
            self.file.seek(self.info.header_offset + 30 + name + extra + skip)
            raw = self.file.read(size)
        else:
            with zipfile.ZipFile(self.file) as archive, archive.open(self.info) as f:
                f.seek(skip)
                raw = f.read(size)
        if len(raw) != size:
            raise OSError(f"{self.name}: {len(raw)} of {size} bytes")
        return np.frombuffer(raw, self.dtype).reshape(stop - start, *self.shape[1:])


@dataclass
class Slice(InputPartition):
    path: str
    start: int
    stop: int


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.values, self.axes = options["values"], options["axes"].split(",")
        self.path, self.task = options["path"], _option(options, "taskBytes", TASK_BYTES)
        self.names = _names(options, "names")  # of the first axis: slices without one are not read

    def _files(self) -> list[str]:
        fs, path = _at(self.path)
        if fs.get_file_info(path).type == pafs.FileType.File:
            return [path]
        found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        return sorted(i.path for i in found if i.path.endswith(".npz"))

    def _labels(self, file, axis: int, size: int) -> np.ndarray:
        name = self.axes[axis]
        with zipfile.ZipFile(file) as archive:
            has = f"{name}.npy" in archive.namelist()
        return Member(file, name).read().astype(str) if has else np.arange(size).astype(str)

    def partitions(self) -> list[Slice]:
        fs, _ = _at(self.path)
        out = []
        for path in self._files():
            with fs.open_input_file(path) as file:
                member = Member(file, self.values)
                rows = max(1, self.task // max(1, member.row))
                names = None if self.names is None else self._labels(file, 0, member.shape[0])
                for start in range(0, member.shape[0], rows):
                    stop = min(start + rows, member.shape[0])
                    if names is None or np.isin(names[start:stop], list(self.names)).any():
                        out.append(Slice(path, start, stop))
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        fs, _ = _at(self.path)
        if part is None:
            return
        with fs.open_input_file(part.path) as file:
            member = Member(file, self.values)
            outer = member.shape[:-1]
            labels = [self._labels(file, i, n) for i, n in enumerate(outer)]
            step = max(1, BATCH_BYTES // max(1, member.row))
            for start in range(part.start, part.stop, step):
                cube = member.read(start, min(start + step, part.stop))
                index = np.indices(cube.shape[:-1]).reshape(len(outer), -1)
                index[0] += start
                ends = np.arange(index.shape[1] + 1, dtype=np.int32) * cube.shape[-1]
                vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(cube.astype(np.float64).ravel()))
                yield pa.RecordBatch.from_arrays([*[pa.array(labels[i][index[i]], pa.string()) for i in range(len(outer))], vec], [*self.axes[: len(outer)], "vec"])


class NpzSource(DataSource):
    """SRC9 / SRC10. Options: ``path`` (an archive or a folder of them), ``values`` (the array), ``axes`` (names of all
    its axes but the last, comma-separated; an array of that name gives the labels, else they are numbers), ``names`` (a JSON
    list of labels of the first axis: slices without any are left out), ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return ", ".join(f"`{a}` string" for a in self.options["axes"].split(",")) + ", vec array<double>"

    def reader(self, schema) -> NpzReader:
        return NpzReader(dict(self.options))


COLUMNS = "kind string, key string, vec array<double>"


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


def _put(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    """A small file, under a temporary name and then moved."""
    temp = f"{path}.tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as out:
        out.write(content)
    fs.move(temp, path)


def _get(fs: pafs.FileSystem, path: str) -> bytes | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_file(path) as f:
        return f.read()


def _pointer(fs: pafs.FileSystem, root: str) -> list[dict]:
    """The current version and the one before, each with its manifest's digest."""
    said = _get(fs, f"{root}/CURRENT")
    return json.loads(said) if said else []


def _manifest(fs: pafs.FileSystem, root: str) -> list[dict]:
    """The files of the newest version whose manifest is as it was written; none of an empty store."""
    versions = _pointer(fs, root)
    for version in versions:
        content = _get(fs, f"{root}/{version['name']}/manifest.json")
        if content is not None and hashlib.sha256(content).hexdigest() == version["sha256"]:
            return json.loads(content)
    if versions:
        raise OSError(f"no version of {root} has its manifest")
    return []


class ShardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.task = options["path"], _option(options, "taskBytes", TASK_BYTES)
        self.kinds, self.keys = _names(options, "kinds"), _names(options, "keys")
        self.low, self.high = options.get("low"), options.get("high")  # keys from and to, both included

    def _may_hold(self, file: dict) -> bool:
        if self.kinds is not None and file["kind"] not in self.kinds:
            return False
        if self.keys is not None and not any(file["first"] <= k <= file["last"] for k in self.keys):
            return False
        return (self.low is None or file["last"] >= self.low) and (self.high is None or file["first"] <= self.high)

    def partitions(self) -> list[Slice]:
        fs, root = _at(self.path)
        out = []
        for file in filter(self._may_hold, _manifest(fs, root)):
            rows = max(1, self.task // max(1, file["row"]))
            out += [Slice(f"{root}/{file['file']}", a, min(a + rows, file["n"])) for a in range(0, file["n"], rows)]
        return out

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs, _ = _at(self.path)
        with fs.open_input_file(part.path) as file:
            kind = str(Member(file, "kind").read()[0])
            keys = Member(file, "key").read(part.start, part.stop)
            values = Member(file, "vec")
            step = max(1, BATCH_BYTES // max(1, values.row))
            for a, b in self._spans(keys, step):
                vec = values.read(part.start + a, part.start + b).astype(np.float64)
                ends = np.arange(b - a + 1, dtype=np.int32) * vec.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * (b - a), pa.string()), pa.array(keys[a:b].astype(str), pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(vec.ravel()))], ["kind", "key", "vec"])

    def _spans(self, keys: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
        """Rows to read, at most ``step`` at once; keys of a file ascend, so named ones are found by bisection."""
        if self.keys is not None:
            for k in sorted(self.keys):
                a, b = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
                yield from ((i, min(i + step, int(b))) for i in range(int(a), int(b), step))
            return
        a = 0 if self.low is None else int(np.searchsorted(keys, self.low, "left"))
        b = len(keys) if self.high is None else int(np.searchsorted(keys, self.high, "right"))
        yield from ((i, min(i + step, b)) for i in range(a, b, step))


class ShardWriter(DataSourceArrowWriter):
    """Tasks write files of at most ``rowsPerFile`` rows of one kind with ascending keys into the version's folder."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.rows, self.overwrite = options["path"], _option(options, "rowsPerFile", ROWS_PER_FILE), overwrite
        self.version = f"v-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _at(self.path)
        fs.create_dir(f"{root}/{self.version}", recursive=True)
        files: list[dict] = []
        held: list[tuple] = []

        def flush() -> None:
            if held:
                files.append(self._file(fs, root, held))
                held.clear()

        for batch in batches:
            for kind, key, vec in zip(*[batch.column(c).to_pylist() for c in ("kind", "key", "vec")], strict=True):
                if kind is None or key is None or vec is None:
                    raise ValueError("kind, key and vec must not be null")
                if held and (kind != held[0][0] or key < held[-1][1] or len(vec) != len(held[0][2]) or len(held) >= self.rows):
                    flush()
                held.append((kind, key, vec))
        flush()
        return Written(files)

    def _file(self, fs: pafs.FileSystem, root: str, rows: list[tuple]) -> dict:
        vec = np.array([r[2] for r in rows], np.float64).reshape(len(rows), -1)
        name = f"{self.version}/{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(f"{root}/{name}") as out:
            np.savez(out, kind=np.array([rows[0][0]]), key=np.array([r[1] for r in rows]), vec=vec)
        return {"file": name, "kind": rows[0][0], "n": len(rows), "first": rows[0][1], "last": rows[-1][1], "row": vec.shape[1] * 8}

    def commit(self, messages: list[Written | None]) -> None:
        """The manifest, then the pointer; then versions that neither the new nor the last one needs go."""
        fs, root = _at(self.path)
        before = _pointer(fs, root)
        kept = [] if self.overwrite or not before else _manifest(fs, root)
        files = kept + sorted((f for m in messages if m for f in m.files), key=lambda f: (f["kind"], f["first"], f["file"]))
        fs.create_dir(f"{root}/{self.version}", recursive=True)
        content = json.dumps(files).encode()
        _put(fs, f"{root}/{self.version}/manifest.json", content)
        now = [{"name": self.version, "sha256": hashlib.sha256(content).hexdigest()}, *before[:1]]
        _put(fs, f"{root}/CURRENT", json.dumps(now).encode())
        used = {v["name"] for v in now}
        for version in now:
            said = _get(fs, f"{root}/{version['name']}/manifest.json")
            used |= {f["file"].split("/")[0] for f in json.loads(said)} if said else set()
        for old in before[1:]:
            if old["name"] not in used and fs.get_file_info(f"{root}/{old['name']}").type == pafs.FileType.Directory:
                fs.delete_dir(f"{root}/{old['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _at(self.path)
        if fs.get_file_info(f"{root}/{self.version}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.version}")


class ShardSource(DataSource):
    """SRC11 / SRC14, SNK6-8. Options: ``path``; writing: ``rowsPerFile``; reading: ``kinds`` and ``keys`` (JSON lists), ``low``
    and ``high`` (keys, both included), ``taskBytes``."""

    @classmethod
    def name(cls) -> str:
        return "vector_shards"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> ShardReader:
        return ShardReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    worker_path(spark)
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(ShardSource)


def write_vectors(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, append: bool = False) -> None:
    """(kind, key, vec) as a new version of a store, in files by ranges of (kind, key)."""
    register(df.sparkSession)
    order = ["kind", "key"]
    rows = df.selectExpr("cast(kind as string) as kind", "cast(key as string) as key", "cast(vec as array<double>) as vec").repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.format("vector_shards").option("path", path).option("rowsPerFile", rows_per_file).mode("append" if append else "overwrite").save()


def read_vectors(spark: SparkSession, path: str, kinds: list[str] | None = None, keys: list[str] | None = None, low: str | None = None, high: str | None = None, **options) -> DataFrame:
    """(kind, key, vec) of the current version: all of it, or of some kinds, keys, or a range of keys (both ends included),
    for which only the archives that have them are read."""
    register(spark)
    asked = {"kinds": kinds and json.dumps(kinds), "keys": None if keys is None else json.dumps(keys), "low": low, "high": high}
    return spark.read.format("vector_shards").options(path=path, **{k: v for k, v in asked.items() if v is not None}, **options).load()


def read_arrays(spark: SparkSession, path: str, values: str, axes: list[str], names: list[str] | None = None, **options) -> DataFrame:
    """A named array of the archives under a path as rows: a column for each axis but the last, and ``vec``; with
    ``names`` only those of the first axis, from the slices that have them."""
    register(spark)
    asked = {"names": json.dumps(names)} if names is not None else {}
    rows = spark.read.format("npz").options(path=path, values=values, axes=",".join(axes), **asked, **options).load()
    return rows if names is None else rows.where(F.col(axes[0]).isin(names))

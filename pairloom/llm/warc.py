"""A deterministic, sharded WARC writer, and the reader that checks what it wrote.

Records are cut into shards at page ids chosen from exact byte sums (a page id that
alone outweighs a shard, and null ids, by payload digest), sorted in each shard, and
written as one gzip member per record; a file is rolled once its
compressed size passes a limit. Headers and digests are made from the payload.
Every task writes under a temporary name of its own and renames the finished
file, so a task that is lost or repeated leaves no half-written archive; the
files that count are those of the manifest, which the driver writes last, under
a temporary name too. Equal input gives equal files, byte for byte.

Of records with equal payloads of ``MIN_REVISIT`` bytes or more, the one with
the smallest page id is written in full (``response``); the others are
``revisit`` records that name it and repeat its HTTP headers without the payload.

The reader takes the files of the manifest and fails if one has other bytes or
another number of records, or if a digest of a record is wrong.

Defined results: a null payload is empty; a null page id sorts last and is never
the target of a revisit unless all ids of the payload are null (then the target
is null too); of rows with equal id and payload one is the response and the
others revisit it (they refer to their own id). Rows of equal id and payload are
written one after the other by one task. A record is in memory as a whole, so a
payload of any length that a task can hold is written. Other columns are ignored,
``url`` may be null.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import Scratch, shared_path, worker_path

MIN_REVISIT = 100
LEAST_SHARD, MOST_SHARDS = 4 << 20, 1 << 18
FILE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
BINS, FINER = 4096, 64


def _files(path: str):
    """The file system that holds ``path``, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _local_uri(path: str) -> str:
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


# ---------------------------------------------------------------- planning


def plan_records(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, digest, size, first (struct of the target) per row. The first of each payload is
    found by aggregation and joined back, so a payload with very many copies stays divisible."""
    body = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url"), body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("bigint").alias("size"))
    rank = F.struct(F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("id"))
    large = base.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.settle(large.select("digest", "first"), "warc-first")
    return base.join(first, "digest", "left").select("page_id", "url", "html", "digest", "size", "first")


def shard_ranges(pages: DataFrame, shard_bytes: int | None = None) -> tuple[list[int], list[int]]:
    """(page ids at which ranges begin, shards of each range and, last, of null ids), from exact sums of
    bytes over equal id ranges; a range that alone outweighs a shard is divided again, one page id
    that does gets several shards. The same for the same rows, however they are split. At most
    ``BINS`` sums, and ``FINER`` for each heavy range, come to the driver in one pass."""
    sized = pages.select(F.col("page_id").cast("bigint").alias("id"), F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("size"))
    low, high, total, none = sized.agg(F.min("id"), F.max("id"), F.sum("size"), F.sum(F.when(F.col("id").isNull(), F.col("size")))).first()
    limit = shard_bytes or max(LEAST_SHARD, -(-(total or 0) // MOST_SHARDS))
    last = max(1, -(-(none or 0) // limit))
    if low is None:
        return [], [1, last]
    step = -(-(high + 1 - low) // BINS)

    def cell(start, width: int):
        """In decimals: ids may be as far apart as longs go."""
        away = F.col("id").cast("decimal(20,0)") - start.cast("decimal(20,0)")
        return (start.cast("decimal(20,0)") + F.floor(away / F.lit(width).cast("decimal(20,0)")) * F.lit(width).cast("decimal(20,0)")).cast("bigint")

    cells = sized.where("id is not null").select("id", "size", cell(F.lit(low), step).alias("start"))
    sums: dict[int, int] = {}
    while True:
        found = cells.groupBy("start").agg(F.sum("size").alias("bytes")).collect()
        heavy = [r.start for r in found if r.bytes > limit and step > 1]
        sums |= {r.start: r.bytes for r in found}
        if not heavy:
            break
        step = -(-step // FINER)
        cells = cells.where(F.col("start").isin(heavy)).select("id", "size", cell(F.col("start"), step).alias("start"))
        sums = {k: v for k, v in sums.items() if k not in set(heavy)}
    edges, parts, run = [], [1], 0
    for start, size in sorted(sums.items()):
        if run and run + size > limit:
            edges.append(start)
            parts.append(1)
            run = 0
        run += size
        parts[-1] = max(1, -(-run // limit))  # beyond the limit a range is one page id
    return edges, [*parts, last]


def shard_edges(pages: DataFrame, shard_bytes: int | None = None) -> list[int]:
    return shard_ranges(pages, shard_bytes)[0]


# ---------------------------------------------------------------- records


def _member(data: bytes) -> bytes:
    """One gzip member without time stamp or name."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record_id(page_id: int | None, digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{nth}')}>"


def make_record(page_id: int | None, url: str | None, html: str, digest: str, target: int | None, revisit: bool, nth: int) -> bytes:
    body = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit else http + body
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, nth)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(target, digest, 0)),
            ("X-Refers-To-Page-Id", "" if target is None else str(target)),
        ]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def make_info(name: str) -> bytes:
    body = f"software: pairloom\r\nformat: WARC File Format 1.1\r\nisPartOf: {name}\r\n".encode()
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'info:' + name)}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


class Roller:
    """Writes records of one shard, a file at a time."""

    def __init__(self, root: str, shard: int, limit: int):
        self.store, self.base = _files(root)
        self.shard, self.limit, self.part, self.out, self.made = shard, limit, 0, None, []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temp = f"{self.base}/_tmp-{uuid.uuid4().hex}-{self.name}"
            self.out, self.size, self.count, self.sum = self.store.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            self._put(_member(make_info(self.name)))
        self._put(_member(record))
        self.count += 1
        if self.size >= self.limit:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.store.move(self.temp, f"{self.base}/{self.name}")
            self.made.append((self.name, self.count, self.size, self.sum.hexdigest()))
            self.out, self.part = None, self.part + 1


def write_archives(pages: DataFrame, root: str, shard_bytes: int | None = None, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Write all pages below ``root`` (a URI that every worker reaches); returns the manifest."""
    spark = pages.sparkSession
    worker_path(spark)
    root = _local_uri(root)
    store, base = _files(root)
    store.create_dir(base, recursive=True)
    scratch = Scratch(spark)
    records = plan_records(pages, scratch)
    edges, parts = shard_ranges(pages, shard_bytes)
    numbered = records.withColumn("shard", _shard_number(edges, parts)(F.coalesce("page_id", F.lit(0)), F.col("page_id").isNull(), F.conv(F.substring("digest", 1, 12), 16, 10).cast("bigint")))
    ordered = numbered.repartitionById(sum(parts), F.col("shard")).sortWithinPartitions(F.col("page_id").isNull(), "page_id", "digest", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, last, nth, made = None, None, 0, []
        for batch in batches:
            for page_id, url, html, digest, size, first, shard in zip(*[batch.column(c) for c in ("page_id", "url", "html", "digest", "size", "first", "shard")], strict=True):
                page_id, digest, shard = page_id.as_py(), digest.as_py(), shard.as_py()
                target = None if not first.is_valid or first["none"].as_py() else first["id"].as_py()
                if roller is None or roller.shard != shard:
                    if roller:
                        roller.close()
                        made += roller.made
                    roller = Roller(root, shard, file_bytes)
                nth = nth + 1 if last == (page_id, digest) else 0
                last = (page_id, digest)
                revisit = first.is_valid and (page_id != target or nth > 0)
                roller.add(make_record(page_id, url.as_py(), html.as_py(), digest, target, revisit, nth))
        if roller:
            roller.close()
            made += roller.made
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes", "sha256"), m, strict=True)) for m in made], pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    files = ordered.select("page_id", "url", "html", "digest", "size", "first", "shard").mapInArrow(run, "file string, records bigint, bytes bigint, sha256 string").collect()
    scratch.clear()
    manifest = sorted((r.asDict() for r in files), key=lambda r: r["file"])  # a line for each file of 64 MB
    temp = f"{base}/_tmp-{uuid.uuid4().hex}-manifest"
    with store.open_output_stream(temp) as out:
        out.write("".join(json.dumps(m, sort_keys=True) + "\n" for m in manifest).encode())
    store.move(temp, f"{base}/manifest.jsonl")
    for name in _left_over(store, base):  # of tasks that were lost
        store.delete_file(name)
    return manifest


def _left_over(store, base: str) -> list[str]:
    from pyarrow import fs

    return [f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("_tmp-")]


def _shard_number(edges: list[int], parts: list[int]):
    """A column function of (page id, whether it is null, a number from the digest): the range by binary
    search, the shard inside it by the digest. Only these columns go to Python."""
    starts, sizes = np.array(edges, np.int64), np.array(parts, np.int64)
    firsts = np.cumsum(sizes) - sizes

    @F.pandas_udf("int")
    def number(page_id: pd.Series, none: pd.Series, digest: pd.Series) -> pd.Series:
        at = np.where(none.to_numpy(bool), len(sizes) - 1, np.searchsorted(starts, page_id.to_numpy(np.int64), side="right"))
        return pd.Series((firsts[at] + digest.to_numpy(np.int64) % sizes[at]).astype(np.int32))

    return number


# ---------------------------------------------------------------- reading


class Summed:
    """A stream that adds up what is read from it."""

    def __init__(self, stream):
        self.stream, self.size, self.sum = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        data = self.stream.read(n)
        self.size += len(data)
        self.sum.update(data)
        return data


def read_members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed members of a gzip file, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                break
        parts.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("archive ends inside a record")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("wrong length")
    if "WARC-Block-Digest" in fields and fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError("wrong block digest")
    return fields, block


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload string"


def read_archives(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """The records of all files in the manifest, whose sizes, numbers of records and digests are verified,
    as are the records' own digests. With ``payload`` the payloads of response records come along."""
    worker_path(spark)
    root = _local_uri(root)
    store, base = _files(root)
    with store.open_input_stream(f"{base}/manifest.jsonl") as f:
        manifest = [json.loads(line) for line in f.read().decode().splitlines()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])
        store, base = _files(root)
        for batch in batches:
            for entry in batch.to_pylist():
                rows, held, records = [], 0, 0
                with store.open_input_stream(f"{base}/{entry['file']}", compression=None) as raw:
                    stream = Summed(raw)
                    for data in read_members(stream):
                        fields, block = parse_record(data)
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        records += 1
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = next(int(h.split(b": ")[1]) for h in http.split(b"\r\n") if h.startswith(b"Content-Length"))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                        if fields["WARC-Type"] == "response" and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
                            raise ValueError("wrong payload digest")
                        number = [int(v) if (v := fields.get(k)) else None for k in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        rows.append((number[0], fields["WARC-Target-URI"], length, digest, fields["WARC-Type"], number[1], body.decode() if payload else None))
                        held += len(body)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                if (records, stream.size, stream.sum.hexdigest()) != (entry["records"], entry["bytes"], entry["sha256"]):
                    raise ValueError(f"{entry['file']} is not what the manifest says: wrong record count, size or digest")
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    listed = spark.createDataFrame([tuple(m[c] for c in ("file", "records", "bytes", "sha256")) for m in manifest], "file string, records bigint, bytes bigint, sha256 string").repartition(max(1, len(manifest)))
    return listed.mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages to a fresh folder of the shared storage and read the archives back:
    page_id, payload_bytes, payload_digest, record_type, refers_to."""
    root = shared_path(pages.sparkSession, "warc")
    write_archives(pages, root)
    return read_archives(pages.sparkSession, root, payload=False).drop("payload", "url")


ORACLE = f"""
with base as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), ranked as (
  select *, min(page_id) over (partition by payload_digest) as first from base
)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= {MIN_REVISIT} and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_REVISIT} and page_id <> first then first end as refers_to
from ranked
"""

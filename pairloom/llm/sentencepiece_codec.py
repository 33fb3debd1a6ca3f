"""SentencePiece encoding with the byte span of every piece, and decoding.

The text is normalised here, by longest-prefix matches in the model's compiled
character map; each normalised byte remembers the original byte it came from.
The merges of the model then run on the normalised string, and the pieces'
lengths cut that alignment into spans of the original UTF-8 text.

Defined results: a null text counts as empty; an empty text has no ids and
decodes to the empty string. Texts of any length are encoded whole. Rows keep their
multiplicity; other columns of the input are ignored. A model's path is one on
every worker.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import fields, map_batches

SPACE = "▁"
SPACE_BYTES = SPACE.encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharMap:
    """The compiled character map: a double-array trie of byte strings and their replacements."""

    def __init__(self, blob: bytes):
        self.rules: dict[str, bytes] = {}
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            values = blob[4 + size :]
            self._walk(units, values)
        self.longest = max(map(len, self.rules), default=0)
        first = sorted({k[0] for k in self.rules})
        self.candidate = re.compile("[" + "".join(map(re.escape, first)) + "]") if first else None

    def _walk(self, units: list[int], values: bytes) -> None:
        """Every key of the trie with its replacement."""

        def below(unit: int) -> int:
            return (unit >> 10) << ((unit & 512) >> 6)

        stack = [(below(units[0]), b"")]
        while stack:
            base, key = stack.pop()
            for byte in range(1, 256):
                at = base ^ byte
                if at >= len(units) or units[at] & 0x800000FF != byte:
                    continue
                unit, grown = units[at], key + bytes([byte])
                child = at ^ below(unit)
                if unit >> 8 & 1:
                    start = units[child] & 0x7FFFFFFF
                    try:
                        self.rules[grown.decode()] = values[start : values.index(b"\0", start)]
                    except UnicodeDecodeError:
                        pass  # no text starts with it
                stack.append((child, grown))

    def chunks(self, text: str):
        """(original string, replacement bytes or None): replacements and the runs between them."""
        if self.candidate is None:
            yield text, None
            return
        done = at = 0
        while hit := self.candidate.search(text, at):
            at = hit.start()
            for n in range(min(self.longest, len(text) - at), 0, -1):
                if (new := self.rules.get(text[at : at + n])) is not None:
                    if at > done:
                        yield text[done:at], None
                    yield text[at : at + n], new
                    at = done = at + n
                    break
            else:
                at += 1
        if done < len(text):
            yield text[done:], None


class Codec:
    """One model: normalise with alignment, encode, project, decode."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.decoder = SentencePieceProcessor(model_proto=model)
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.merger = SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.lengths = np.array([1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else len(p.piece.encode()) for p in proto.pieces])

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised string, and for each of its bytes (and its end) the original byte."""
        out, source, at, ends_in_space = [], [], 0, self.squeeze
        for old, new in self.charmap.chunks(text):
            old_bytes = old.encode()
            got = old_bytes if new is None else new
            where = np.arange(at, at + len(got)) if new is None else np.full(len(got), at)
            at += len(old_bytes)
            if self.squeeze and got:
                is_space = np.frombuffer(got, np.uint8) == 32
                before = np.concatenate(([ends_in_space], is_space[:-1]))
                keep = ~(is_space & before)
                ends_in_space = bool(is_space[-1])
                got, where = np.frombuffer(got, np.uint8)[keep].tobytes(), where[keep]
            out.append(got)
            source.append(where)
        data, align, end = b"".join(out), np.concatenate([*source, np.zeros(0, int)]).astype(np.int64), at
        if not data:
            return "", np.array([0])
        if self.dummy:
            data = data + b" " if self.suffix else b" " + data
            align = np.append(align, end) if self.suffix else np.append(align[:1], align)
        if self.escape:
            align = np.repeat(align, np.where(np.frombuffer(data, np.uint8) == 32, len(SPACE_BYTES), 1))
            data = data.replace(b" ", SPACE_BYTES)
        space = SPACE_BYTES if self.escape else b" "
        while self.squeeze and data.endswith(space):  # a literal escape sign at the end goes, too
            end = int(align[len(data) - len(space)])
            data, align = data[: -len(space)], align[: -len(space)]
        return data.decode(), np.append(align, end)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the start and end byte of each in the original text."""
        norm, align = self.normalise(text)
        ids = np.array(self.merger.encode(norm), np.int64)
        size = self.lengths[ids] if len(ids) else np.zeros(0, np.int64)
        if (size < 0).any():  # unknown pieces cover what the library says they cover
            size = np.array([len(p.surface.encode()) for p in self.merger.encode(norm, return_type="proto").pieces])
        cut = np.concatenate(([0], np.cumsum(size)))
        return ids, align[cut[:-1]], align[cut[1:]]

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)


@lru_cache(maxsize=4)
def codec_at(path: str | None) -> Codec:
    """The codec of a model file; without a path the worker looks the default model up where it runs."""
    with open(path or default_model(), "rb") as f:
        return Codec(f.read())


def encode_documents(docs: DataFrame, model: str | None = None, spans: bool = True) -> DataFrame:
    """doc_id, ids, and with ``spans`` the original byte spans (starts, ends), per row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = codec_at(model)
        made = [codec.encode(t or "") for t in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id")] + [pa.array([m[i] for m in made], pa.list_(pa.int64())) for i in range(3 if spans else 1)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "starts", "ends"][: len(columns)])

    more = ", starts array<bigint>, ends array<bigint>" if spans else ""
    return map_batches(fields(docs, "doc_id", "text"), run, f"doc_id bigint, ids array<bigint>{more}")


def decode_ids(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and decoded text per row of (doc_id, ids)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = codec_at(model)
        texts = [codec.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return map_batches(fields(encoded, "doc_id", "ids"), run, "doc_id bigint, decoded string")


DIGEST_SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, spans_sha256 string, decoded_sha256 string"


def digest_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Digests of ids, spans and decoded text; one pass over the texts, no shuffle."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, rows = codec_at(model), []
        for text in batch.column("text"):
            ids, starts, ends = codec.encode(text.as_py() or "")
            listed = ids.tolist()
            rows.append((
                len(listed),
                hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest(),
                hashlib.sha256(np.stack([starts, ends], 1).astype("<i8").tobytes()).hexdigest(),
                hashlib.sha256(codec.decode(listed).encode()).hexdigest(),
            ))
        n, *texts = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), *[pa.array(t, pa.string()) for t in texts]],
            ["doc_id", "n_tokens", "ids_sha256", "spans_sha256", "decoded_sha256"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, DIGEST_SCHEMA)

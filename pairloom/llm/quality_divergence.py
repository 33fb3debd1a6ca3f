"""Quality rules: how far a document's distributions are from its language's.

Two histograms per document, over classes of characters and over common words,
are compared with references of the language by Jensen-Shannon distance. The
references are exact sums over all documents that pass the base rules. Words
are counted in a fixed number of hash buckets, so the sums stay bounded however
large the vocabulary; a language's heaviest buckets are its common words, the
others count as one (words that share a bucket count as one word on both sides).
Guards on the length keep short documents from being judged by too few characters
or words.

How far is too far is learned from the distances themselves, of all documents that
pass the base rules: a distance counts from the median of the language's documents
of like length, and where these excesses fall into two groups whose means are
``LEAST_GAP`` or more apart, the cut that parts the groups best (greatest variance
between them) is the limit. In a table without such a second group nobody fails.

Defined results: null and empty texts have no words and fail the base rules. A
document whose language is null, or none of the ``MOST_LANGUAGES`` with the most
documents, is held against every reference and takes the nearest (by words, then
characters, then the name that sorts first). With no reference at all the base
rules alone decide. Texts of any length are counted whole; repeated rows count as
often as they are there; columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.common import map_batches
from pairloom.session import settle

BUCKETS = 4096
COMMON = 64
MOST_LANGUAGES = 1000
MIN_WORDS, REPEAT_PERCENT = 50, 50
GUARD_CHARS, GUARD_WORDS = 256, 64
BINS = 1024  # of a distance between 0 and 1
BANDS = (5, 12)  # documents of like length: by the logarithm of their words, between these
LEAST_GAP = 0.15

SYMBOLS = b"#*$%&|<>"
CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "quote", "symbol", "mark", "control", *[f"lead_{b:02x}" for b in range(0xC2, 0xF5)]]


def _class_table() -> np.ndarray:
    """The class of each byte. A character of several bytes is classed by its first, which tells scripts
    apart; the bytes that continue it count for nothing."""
    table = np.full(256, CLASSES.index("mark"), np.int64)
    table[0:32] = table[127] = CLASSES.index("control")
    table[128:] = len(CLASSES)
    table[0xC2:0xF5] = np.arange(CLASSES.index("lead_c2"), len(CLASSES))
    for name, members in {
        "lower": b"abcdefghijklmnopqrstuvwxyz",
        "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "digit": b"0123456789",
        "blank": b" \t",
        "line": b"\n\r",
        "stop": b".,;:!?",
        "quote": b"'\"()[]-",
        "symbol": SYMBOLS,
    }.items():
        table[list(members)] = CLASSES.index(name)
    return table


TABLE = _class_table()
EDGES = b".,;:!?'\"()[]-" + SYMBOLS


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pair = ids[:-1] * len(seen) + ids[1:]
    if len(seen) >= 1 << 20:  # three ids would overflow a long: number the pairs first
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(seen) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(window)] |= twice
    return int(covered.sum())


def duplicate_lines(data: bytes) -> int:
    seen, n = set(), 0
    for line in data.split(b"\n"):
        if line.split():
            n += line in seen
            seen.add(line)
    return n


def base_features(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    code_points = len(data.decode()) if not data.isascii() else len(data)
    word_chars = code_points - sum(map(data.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
    symbols = sum(data.count(bytes([c])) for c in SYMBOLS)
    repeated = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
    return len(words), word_chars, symbols, duplicate_lines(data), repeated, failed


def histograms(data: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by character class; the word buckets there are, and their counts."""
    chars = np.bincount(TABLE[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]
    counts = Counter(data.lower().split())
    at = np.fromiter((zlib.crc32(w.strip(EDGES)) % BUCKETS for w in counts), np.int64, len(counts))
    return chars, at, np.fromiter(counts.values(), np.int64, len(counts))


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of histogram ``p`` and each row of ``q``."""
    p, q = p / max(p.sum(), 1), q / np.maximum(q.sum(axis=-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=-1)
    return np.sqrt(np.maximum((left + right) / 2, 0))


def learn_references(docs: DataFrame) -> DataFrame:
    """(lang, kind, at, n): exact sums over all documents with a language that pass the base rules: kind 0
    by character class, 1 by word bucket (the common ones; at -1 the others), 2 the documents. At most
    ``MOST_LANGUAGES`` languages of 126 rows are left, and each task sends 4,158 rows for a language."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
            data = text.as_py().encode()
            words = data.split()
            if base_features(data, words)[-1]:
                continue
            chars, at, counts = histograms(data, words)
            of = sums.setdefault(lang.as_py(), (np.zeros(len(CLASSES), np.int64), np.zeros(BUCKETS, np.int64), np.zeros(1, np.int64)))
            of[0][:] += chars
            of[1][:] += np.bincount(at, counts, BUCKETS).astype(np.int64)
            of[2][0] += 1
        rows = [(lang, kind, int(i), int(h[i])) for lang, each in sums.items() for kind, h in enumerate(each) for i in np.flatnonzero(h)]
        return pa.RecordBatch.from_pylist([dict(zip(("lang", "kind", "at", "n"), r, strict=True)) for r in rows], pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("at", pa.int32()), ("n", pa.int64())]))

    usable = docs.select("text", "lang").where("text is not null and lang is not null")
    sums = settle(map_batches(usable, run, "lang string, kind int, at int, n bigint").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")), "quality-sums")
    chosen = sums.where("kind = 2").orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).select("lang")
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.col("n").desc(), "at"))  # of 4,096 rows at most
    named = sums.join(F.broadcast(chosen), "lang").withColumn("place", place)
    folded = named.withColumn("at", F.when((F.col("kind") == 1) & (F.col("place") > COMMON), F.lit(-1)).otherwise(F.col("at")))
    return folded.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))


class References:
    def __init__(self, rows: list[tuple[str, int, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.chars = np.zeros((len(self.langs), len(CLASSES)))
        #: per language, the place of each bucket among its common words; COMMON for the others
        self.place = np.full((len(self.langs), BUCKETS), COMMON, np.int16)
        self.words = np.zeros((len(self.langs), COMMON + 1))
        number = {lang: i for i, lang in enumerate(self.langs)}
        for lang, kind, at, n in sorted(rows, key=lambda r: (r[0], r[1], -r[3], r[2])):
            i = number[lang]
            if kind == 0:
                self.chars[i, at] = n
            elif kind == 1 and at < 0:
                self.words[i, COMMON] = n
            elif kind == 1:
                free = int(np.count_nonzero(self.place[i] < COMMON))
                self.place[i, at], self.words[i, free] = free, n

    def distances(self, lang: str | None, chars: np.ndarray, at: np.ndarray, counts: np.ndarray) -> tuple[float, float, str]:
        """By characters and by words to the language's reference, else to the nearest; its language."""
        which = [self.langs.index(lang)] if lang in self.langs else range(len(self.langs))
        far = [(float(divergence(np.bincount(self.place[i, at], counts, COMMON + 1), self.words[i])), float(divergence(chars, self.chars[i])), self.langs[i]) for i in which]
        by_words, by_chars, name = min(far)
        return by_chars, by_words, name


def best_cut(excess: dict[int, int]) -> float | None:
    """Where a histogram of excesses (bin: count) parts into two groups with the greatest variance between
    them; None if their means are too near."""
    if len(excess) < 2:
        return None
    bins = np.array(sorted(excess))
    n = np.array([excess[b] for b in bins.tolist()], float)
    below, above = np.cumsum(n)[:-1], n.sum() - np.cumsum(n)[:-1]
    low = np.cumsum(n * bins)[:-1] / below
    high = ((n * bins).sum() - np.cumsum(n * bins)[:-1]) / above
    k = int(np.argmax(below * above * (high - low) ** 2))
    return float(bins[k] + bins[k + 1]) / 2 / BINS if high[k] - low[k] >= LEAST_GAP * BINS else None


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, char_distance double, word_distance double, reference string"


def measure(docs: DataFrame) -> DataFrame:
    """Base features, and the distances from the nearest reference and its language (null where a guard, a
    base rule or a missing reference forbids them)."""
    # bounded by MOST_LANGUAGES, not by the documents
    references = References([tuple(r) for r in learn_references(docs).collect()])

    def one(text: str | None, lang: str | None) -> tuple:
        data = (text or "").encode()
        words = data.split()
        base = base_features(data, words)
        if base[-1] or not references.langs:
            return *base, None, None, None
        chars, at, counts = histograms(data, words)
        by_chars, by_words, name = references.distances(lang, chars, at, counts)
        return *base, by_chars if chars.sum() >= GUARD_CHARS else None, by_words if len(words) >= GUARD_WORDS else None, name

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.string()]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [one(t.as_py(), g.as_py()) for t, g in zip(batch.column("text"), batch.column("lang"), strict=True)]
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]], names)

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang"), run, SCHEMA)


def band():
    return F.greatest(F.lit(BANDS[0]), F.least(F.lit(BANDS[1]), F.floor(F.log2("n_words")).cast("int")))


def usual_distances(measured: DataFrame) -> tuple[DataFrame, dict[str, float | None]]:
    """(the median distances of each language and band of lengths, the limits of the excess over them). The
    histograms are exact: ``BINS`` rows for a language, band and distance; those of the excess, over all,
    come to the driver."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("far")) for c in ("char_distance", "word_distance")]))
    long = measured.where("reference is not null").select("reference", band().alias("band"), each.alias("x")).select("reference", "band", "x.*").where("far is not null")
    counts = settle(long.groupBy("reference", "band", "kind", F.floor(F.col("far") * BINS).cast("int").alias("bin")).agg(F.count("*").alias("n")), "quality-bins")
    group = Window.partitionBy("reference", "band", "kind")
    so_far = F.sum("n").over(group.orderBy("bin"))
    middle = counts.withColumns({"c": so_far, "all": F.sum("n").over(group)}).where(2 * F.col("c") >= F.col("all")).groupBy("reference", "band", "kind").agg(F.min("bin").alias("middle"))
    excess = counts.join(middle, ["reference", "band", "kind"]).groupBy("kind", (F.col("bin") - F.col("middle")).alias("excess")).agg(F.sum("n").alias("n")).collect()
    limits = {k: best_cut({r.excess: r.n for r in excess if r.kind == k}) for k in ("char_distance", "word_distance")}
    of = lambda k: F.max(F.when(F.col("kind") == k, (F.col("middle") + 0.5) / BINS)).alias(f"usual_{k}")
    return middle.groupBy("reference", "band").agg(of("char_distance"), of("word_distance")), limits


def assess(docs: DataFrame) -> DataFrame:
    """Base features, distances and the verdict."""
    measured = settle(measure(docs), "quality-measured")
    usual, limits = usual_distances(measured)
    joined = measured.withColumn("band", band()).join(F.broadcast(usual), ["reference", "band"], "left")
    far = F.lit(False)
    for kind, limit in limits.items():
        if limit is not None:
            far = far | F.coalesce(F.col(kind) - F.col(f"usual_{kind}") > limit, F.lit(False))
    return joined.select(*measured.columns[:-1], (~F.col("base_failed") & ~far).alias("kept"))

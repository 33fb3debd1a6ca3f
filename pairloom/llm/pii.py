"""Personal data: base patterns, and identifiers found by their contexts.

Base spans come from four fixed patterns (email, ip, card, phone), leftmost and
non-overlapping for each kind; matches that fail their check are dropped.

The bootstrap starts from seed entities: the base spans, and entities of two more
kinds that are told by their form alone (``secret``: a run of ``SECRET`` or more
letters and digits, both mixed; ``id``: social security and bank account numbers),
which are no spans yet.

1. A lexical pattern is the two words before a place, or the two words behind it
   (lower-cased, digits as 0, without punctuation). Seeds induce the patterns
   around them; those with too few different seeds of a kind go, and, after a count
   of all places where the two words stand, those that seeds seldom fill.
2. The words, or runs of groups of digits, that fill a pattern anywhere else and
   that no seed touches are its candidates. An instance is a candidate's first word
   or two; all its occurrences are counted, wherever they are.
3. Patterns and instances form a graph, which Spark scores in ``ROUNDS`` rounds: a
   pattern's score is the mean over its different seeds (1 each) and instances, an
   instance's the sum of the scores of the patterns it fills over all its
   occurrences, so a word that is common elsewhere stays low.
4. Patterns of a high score and support are trusted. Candidates of a high score in
   one become spans of the kind that most of its seeds have; so do the seeds of the
   two further kinds that stand in one.

Contexts count different seeds, not occurrences, so copies of a document add
nothing. Patterns and instances are 64-bit hashes; texts are read in passes without
a shuffle, with a bitmap of 4 MB that tells which hashes matter, however many do.

Defined results: a null or empty text has no span. Kinds, starts and ends are
listed as ``kind:start:end`` in code points, end exclusive. Of kinds with as many
seeds in a pattern the name that sorts last is the pattern's. A candidate in two
trusted patterns takes the kind of the higher score, then the name that sorts last.
Twin rows share their spans. Texts of any length are taken whole, in linear time.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import bitmap, in_bitmap, map_batches, row_key
from pairloom.llm.shingles import CHUNK, SPACE, combine, words_of
from pairloom.session import Scratch, settle

# The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before the first part would have begun the match itself, so none is tried from inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")

MORE_KINDS = ("secret", "id")
SECRET = 24
SECRETS = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9]{{{SECRET},}}+")
IDS = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+)(?![0-9A-Za-z-])")

ROUNDS = 3
MIN_SEEDS, MIN_SUPPORT = 2, 3  # different seeds of a kind to begin with; different seeds and instances in the end
MIN_FILLED = 0.2  # of a pattern's places, by seeds
MIN_SCORE, MIN_INSTANCE = 0.6, 0.5
DIGIT = re.compile(r"[0-9]")
GROUPS = re.compile(rb"(?<![^\x20\x09-\x0D])[(+]?[0-9][0-9().+/-]*(?:\x20[(+]?[0-9][0-9().+/-]*)*(?![^\x20\x09-\x0D,;:!?'\"])")
TRIM = b".,;:!?'\"()[]{}<>#*$%&|"
#: Bytes as they count in patterns: letters lower-cased, digits as 0, punctuation as a blank.
PLAIN = bytes(32 if c in TRIM else 48 if 48 <= c < 58 else c + 32 if 65 <= c < 91 else c for c in range(256))
ALNUM = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @ outwards, in time proportional to the text; the same spans as scanning for
    local part, @ and domain from left to right."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and LOCAL.match(text, start - 1):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            floor = domain.end()
        at = text.find("@", max(at + 1, floor))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(map(m[0].count, "0123456789")) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind in the order of ``KINDS``, then start."""
    found = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            found += [("ip", *s) for s in ips(text)]
        found += [("card", *s) for s in cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in phones(text)]
    return found


def more_seeds(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Seeds of the further kinds, apart from the base spans and each other."""
    taken, out = sorted((s, e) for _, s, e in base), []
    for kind, pattern in (("id", IDS), ("secret", SECRETS)):
        for m in pattern.finditer(text):
            low, high = m.span()
            digits = sum(map(m[0].count, "0123456789"))
            if kind == "secret" and not 4 <= digits <= len(m[0]) - 4:
                continue
            at = bisect_left(taken, (low, high))
            if (at and taken[at - 1][1] > low) or (at < len(taken) and taken[at][0] < high):
                continue
            taken.insert(at, (low, high))
            out.append((kind, low, high))
    return out


class Places:
    """Code points of a UTF-8 text by byte, and bytes by code point."""

    def __init__(self, raw: bytes):
        codes = np.frombuffer(raw, np.uint8)
        self.lead = None if raw.isascii() else np.append(np.flatnonzero(codes & 0xC0 != 0x80), len(raw))

    def byte(self, point: int) -> int:
        return point if self.lead is None else int(self.lead[point])

    def point(self, byte: int) -> int:
        return byte if self.lead is None else int(np.searchsorted(self.lead, byte))


def pairs_of(h: np.ndarray) -> np.ndarray:
    return combine(np.stack([h[:-1], h[1:]])) if len(h) > 1 else np.zeros(0, np.uint64)


def word_tables(texts: pa.Array) -> Iterator[tuple]:
    """(index of the first text, raw texts, their places in the group, word starts, ends, hashes, text of
    each word, hash of each word and the next, whether both are of one text), for texts by the
    megabyte."""
    group, first, size = [], 0, 0
    for i, text in enumerate(texts):
        group.append((text.as_py() or "").encode())
        size += len(group[-1]) + 1
        if size >= CHUNK or i == len(texts) - 1:
            offset = np.concatenate(([0], np.cumsum([len(g) + 1 for g in group])))
            start, end, h = words_of(b"\n".join(group).translate(PLAIN))
            of = np.searchsorted(offset, start, side="right") - 1
            yield first, group, offset, start, end, h, of, pairs_of(h), of[1:] == of[:-1]
            group, first, size = [], i + 1, 0


def patterns_around(raw: bytes, places: Places, spans: list[tuple[str, int, int]]) -> list[tuple[int | None, int | None]]:
    """(hash of the two words before, hash of the two words behind) of each span; None: there aren't two."""
    start, end, h = words_of(raw.translate(PLAIN))
    pairs = pairs_of(h).view(np.int64)
    out = []
    for _, s, e in spans:
        i = int(np.searchsorted(end, places.byte(s), side="right"))
        j = int(np.searchsorted(start, places.byte(e)))
        out.append((int(pairs[i - 2]) if i >= 2 else None, int(pairs[j]) if j + 1 < len(h) else None))
    return out


SEEDS = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("v", pa.int64()), ("l", pa.int64()), ("r", pa.int64())]))
SCAN = "k1 bigint, k2 bigint, doc_id bigint, seeds array<struct<kind:string,s:int,e:int,v:bigint,l:bigint,r:bigint>>"


def scan(docs: DataFrame) -> DataFrame:
    """All seeds of every whole text, with a hash of what they say (v) and their patterns (l, r), one pass."""
    k1, k2 = row_key("doc_id", "text")

    def long_runs(group: list[bytes]) -> np.ndarray:
        """Which texts have a run of letters and digits that may be a secret."""
        codes = np.frombuffer(b"\n".join(group), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ALNUM[codes], [False])).astype(np.int8)))
        at = edges[::2][edges[1::2] - edges[::2] >= SECRET]
        found = np.zeros(len(group), bool)
        found[np.searchsorted(np.cumsum([len(g) + 1 for g in group]), at, side="right")] = True
        return found

    def one(raw: bytes, secret: bool) -> list[dict]:
        text = raw.decode()
        base = base_spans(text)
        spans = base + (more_seeds(text, base) if secret or DIGIT.search(text) else [])
        if not spans:
            return []
        around = patterns_around(raw, Places(raw), spans)
        said = [int.from_bytes(hashlib.blake2b(text[s:e].lower().encode(), digest_size=8).digest(), "little", signed=True) for _, s, e in spans]
        return [{"kind": k, "s": s, "e": e, "v": v, "l": left, "r": right} for (k, s, e), v, (left, right) in zip(spans, said, around, strict=True)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, group, size = [], [], 0
        for i, text in enumerate(batch.column("text")):
            group.append((text.as_py() or "").encode())
            size += len(group[-1])
            if size >= CHUNK or i == batch.num_rows - 1:
                found += [one(raw, bool(secret)) for raw, secret in zip(group, long_runs(group), strict=True)]
                group, size = [], 0
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k1", "k2", "doc_id")], pa.array(found, SEEDS)], ["k1", "k2", "doc_id", "seeds"])

    slim = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(slim, run, SCAN)


def totals(docs: DataFrame, keys: DataFrame, key: str, words: bool) -> DataFrame:
    """(key, total): how often each hash of two words (with ``words``, of one word, too) occurs in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(keys, key))

    def run(batch: pa.RecordBatch):
        for _, _, _, _, _, h, _, pairs, whole in word_tables(batch.column("text")):
            every = np.concatenate((pairs[whole], h)) if words else pairs[whole]
            found, n = np.unique(every[in_bitmap(shared.value, every)].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], [key, "n"])

    return map_batches(docs.select("text").where("text is not null"), run, f"{key} bigint, n bigint").groupBy(key).agg(F.sum("n").alias("total")).join(keys.select(key), key, "left_semi")


FOUND = "k1 bigint, k2 bigint, pattern bigint, instance bigint, s int, e int"


def candidates(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Units that fill a pattern (its hash for the left side, the complement of it for the right), one pass."""
    k1, k2 = row_key("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(patterns, "pattern"))

    def one(raw: bytes, hits: list[tuple[int, int]], start: np.ndarray, end: np.ndarray, h: np.ndarray, pairs: np.ndarray) -> Iterator[tuple]:
        """``hits`` are (word, pattern); words are counted and placed in this text."""
        text, places = raw.decode(), Places(raw)
        base = base_spans(text)
        taken = sorted((places.byte(s), places.byte(e)) for _, s, e in base + more_seeds(text, base))
        lows = [t[0] for t in taken]
        reach = np.maximum.accumulate([t[1] for t in taken]).tolist() if taken else []
        edges = np.flatnonzero(np.diff(np.concatenate(([False], ~SPACE[np.frombuffer(raw, np.uint8)], [False])).astype(np.int8))).tolist()
        opens, closes = edges[::2], edges[1::2]
        runs = [m.span() for m in GROUPS.finditer(raw)] if DIGIT.search(text) else []
        run_opens = [r[0] for r in runs]
        for i, pattern, left in hits:
            a, z = int(start[i]), int(end[i])
            k = bisect_right(run_opens, a) - 1
            if k >= 0 and a < runs[k][1]:
                low = runs[k][0]
                high = low + len(raw[low : runs[k][1]].rstrip(TRIM))
            else:
                t = bisect_right(opens, a) - 1
                word = raw[opens[t] : closes[t]]
                low = opens[t] + len(word) - len(word.lstrip(TRIM))
                high = opens[t] + len(word.rstrip(TRIM))
            if (raw[low:a] if left else raw[z:high]).strip(TRIM) or low >= high:
                continue  # the word is not the unit's first (its last)
            t = bisect_left(lows, high)
            if t and reach[t - 1] > low:
                continue
            first = int(np.searchsorted(start, low))
            alone = first + 1 >= len(start) or start[first + 1] >= high
            yield pattern, int((h if alone else pairs)[first]), places.point(low), places.point(high)

    def run(batch: pa.RecordBatch):
        bits, own1, own2 = shared.value, batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
        for begin, group, offset, start, end, h, of, pairs, whole in word_tables(batch.column("text")):
            at = np.flatnonzero(whole)
            # left: the words at and at + 1, then the unit at at + 2; right: the unit at at - 1
            left = at[(at + 2 < len(h)) & in_bitmap(bits, pairs[at])]
            left = left[of[left + 2] == of[left]]
            right = at[(at > 0) & in_bitmap(bits, ~pairs[at])]
            right = right[of[right - 1] == of[right]]
            by_text: dict[int, list] = {}
            for places, step, side in ((left, 2, pairs), (right, -1, ~pairs)):
                for t, w, p in zip(of[places].tolist(), (places + step).tolist(), side[places].view(np.int64).tolist(), strict=True):
                    by_text.setdefault(t, []).append((w, p, step == 2))
            rows = []
            for t, hits in by_text.items():
                low, high = np.searchsorted(of, [t, t + 1])
                local = [(w - low, p, s) for w, p, s in hits]
                made = one(group[t], local, start[low:high] - offset[t], end[low:high] - offset[t], h[low:high].view(np.int64), pairs[low : max(low, high - 1)].view(np.int64))
                rows += [(own1[begin + t], own2[begin + t], *r) for r in made]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["k1", "k2", "pattern", "instance", "s", "e"])

    found = map_batches(docs.where("text is not null").select(k1.alias("k1"), k2.alias("k2"), "text"), run, FOUND)
    return found.join(patterns.select("pattern"), "pattern", "left_semi")


def induced(seeds: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(pattern, side, kind, n_seeds): patterns with enough different seeds of a kind, which fill enough of
    their places. ``seeds`` has a row for each seed and side: pattern, pair, side, kind, v."""
    different = seeds.groupBy("pattern", "pair", "side", "kind", "v").agg(F.count("*").alias("times"))
    by_kind = different.groupBy("pattern", "pair", "side", "kind").agg(F.count("*").alias("n"), F.sum("times").alias("times"))
    top = by_kind.groupBy("pattern", "pair", "side").agg(F.max(F.struct("n", "kind")).alias("m"), F.sum("n").alias("n_seeds"), F.sum("times").alias("times"))
    top = scratch.settle(top.where(F.col("m.n") >= MIN_SEEDS).select("pattern", "pair", "side", "m.kind", "n_seeds", "times"), "pii-top")
    every = totals(docs, top.select("pair").distinct(), "pair", False)
    return scratch.settle(top.join(every, "pair").where(F.col("times") >= MIN_FILLED * F.col("total")).select("pattern", "side", "kind", "n_seeds"), "pii-induced")


def bootstrap(patterns: DataFrame, edges: DataFrame, every: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns with their scores and support, instances with theirs). ``patterns`` (pattern, side, kind,
    n_seeds), ``edges`` (pattern, instance, n), ``every`` (instance, total)."""
    scores = edges.select("instance").distinct().withColumn("score", F.lit(0.0))
    known = edges.join(every, "instance")
    for _ in range(rounds):
        filled = edges.join(scores, "instance").groupBy("pattern").agg(F.sum("score").alias("got"), F.count("*").alias("n"))
        support = F.col("n_seeds") + F.coalesce("n", F.lit(0))
        scored = patterns.join(filled, "pattern", "left").select("pattern", "side", "kind", support.alias("support"), ((F.col("n_seeds") + F.coalesce("got", F.lit(0.0))) / support).alias("score"))
        scored = scratch.settle(scored, "pii-patterns")
        # a place may fill a pattern on either side: the better side counts
        sides = known.join(scored.select("pattern", "side", "score"), "pattern").groupBy("instance", "side").agg((F.sum(F.col("n") * F.col("score")) / F.first("total")).alias("score"))
        scores = scratch.settle(sides.groupBy("instance").agg(F.least(F.max("score"), F.lit(1.0)).alias("score")), "pii-scores")
    return scored, scores


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more): arrays of (kind, s, e) per row; more are the spans found by context."""
    scratch = Scratch(docs.sparkSession)
    scanned = settle(scan(docs), "pii-scan")
    own = scanned.where(F.size("seeds") > 0).dropDuplicates(["k1", "k2"]).select("k1", "k2", F.explode("seeds").alias("f")).select("k1", "k2", "f.*")
    sides = F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("pair"), F.col("l").alias("pattern")), F.struct(F.lit("r").alias("side"), F.col("r").alias("pair"), F.bitwise_not("r").alias("pattern"))))
    seeds = scratch.settle(own.select("k1", "k2", "kind", "s", "e", "v", sides.alias("x")).select("k1", "k2", "kind", "s", "e", "v", "x.*").where("pair is not null"), "pii-seeds")
    patterns = induced(seeds, docs, scratch)
    found = scratch.settle(candidates(docs, patterns).distinct(), "pii-found")
    edges = scratch.settle(found.groupBy("pattern", "instance").agg(F.count("*").alias("n")), "pii-edges")
    every = scratch.settle(totals(docs, edges.select("instance").distinct(), "instance", True), "pii-every")
    scored, scores = bootstrap(patterns, edges, every, scratch)
    trusted = scratch.settle(scored.where((F.col("score") >= MIN_SCORE) & (F.col("support") >= MIN_SUPPORT)).select("pattern", "kind", "score"), "pii-trusted")
    good = found.join(scores.where(F.col("score") >= MIN_INSTANCE).select("instance"), "instance").join(trusted, "pattern")
    new = good.groupBy("k1", "k2", "s", "e").agg(F.max(F.struct("score", "kind")).alias("m")).select("k1", "k2", "m.kind", "s", "e")
    confirmed = seeds.where(F.col("kind").isin(*MORE_KINDS)).join(trusted.select("pattern"), "pattern", "left_semi").select("k1", "k2", "kind", "s", "e").distinct()
    more = settle(new.unionByName(confirmed).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("kind", "s", "e"))).alias("more")), "pii-more")
    scratch.clear()
    spans = "array<struct<kind:string,s:int,e:int>>"
    plain = F.transform(F.filter("seeds", lambda x: x["kind"].isin(*KINDS)), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))).cast(spans)
    rows = scanned.select("k1", "k2", "doc_id", plain.alias("base")).join(more, ["k1", "k2"], "left")
    return rows.select("doc_id", "base", F.coalesce("more", F.array().cast(spans)).alias("more"))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base spans, then those found by
    context, by kind as listed, the further kinds last, then start), n_more (found by context), n_spans
    (all), per row."""
    found = extract(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    every = F.concat("base", "more")
    rank = F.array(*[F.lit(k) for k in KINDS + MORE_KINDS])
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(F.array_position(rank, x["kind"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(ordered).alias("spans"), F.size("more").cast("bigint").alias("n_more"), F.size(every).cast("bigint").alias("n_spans"))


def base_digest(text: str | None) -> str:
    """The digest of a text's base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text or "")).encode()).hexdigest()

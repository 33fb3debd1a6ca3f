"""Importance resampling, vector codes and chat formatting against brute force, round trips and SQL."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, duck_rows, spark_rows
from pyspark.sql import functions as F

from pairloom.llm import chat_format, importance_resampling, vector_codes
from pairloom.llm import queries as Q
from pairloom.session import table


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_chat_format"])
def test_matches_sql(spark, sf, name):
    assert spark_rows(Q.QUERIES[name](spark, sf)) == duck_rows(connect(sf), Q.ORACLES[name])


# -- importance resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def slow_resampling(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = [0] * 10000, [0] * 10000
    for text, counts in [*((d[1], s) for d in docs), *((x, t) for x in target)]:
        for f in slow_features(text)[1]:
            counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000.0) / ((a + 1) * (sum(t) + 10000.0)))) for a, b in zip(s, t, strict=True)]
    out = []
    for ident, text in docs:
        words, features = slow_features(text)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    may = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): i + 1 for i, r in enumerate(may[: 5 * len(may) // 100])}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in out), key=repr)


def resampled(spark, docs, target):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({n: F.lit(1) for n in ("score", "n_words", "rank", "part", "at", "_own_text")})
    got = importance_resampling.digest(d, spark.createDataFrame([(t,) for t in target], "text string"))
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr)


def test_resampling_is_the_slow_one(spark):
    rng = random.Random(5)
    vocabulary = [*"the of And ÉTÉ Été x1 07 漢字 naïve ß".split(), *(f"w{i}" for i in range(60))]
    docs = [(i, rng.choice([" ", "\n", ", ", "_"]).join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(300)]
    docs += [(301, None), (302, ""), (303, "!?\x7f"), (None, "a b c " * 10), (7, docs[7][1]), (7, "Other text " * 20)]
    target = [None, "", "the of and w1 w2 w3", "W1 w2 W3 été"]
    assert resampled(spark, docs, target) == slow_resampling(docs, target)


def test_resampling_of_the_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, sf, "benchmark").select("text").collect()]
    got = Q.op11_importance_resampling(spark, sf).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got), key=repr) == slow_resampling(docs, target)


def test_blocks_of_words_do_not_matter(monkeypatch):
    text = " ".join(f"Word{i % 7}-{i}" for i in range(500)) + "  tail "
    whole = importance_resampling.buckets(text)
    monkeypatch.setattr(importance_resampling, "BLOCK", 13)
    parts = importance_resampling.buckets(text)
    assert parts[0] == whole[0] == len(slow_features(text)[0])
    assert sorted(parts[1].tolist()) == sorted(whole[1].tolist()) == sorted(zlib.crc32(f.encode()) % 10000 for f in slow_features(text)[1])


def test_resampling_of_nothing(spark):
    assert resampled(spark, [], ["x"]) == []
    assert resampled(spark, [(1, "a b")], []) == slow_resampling([(1, "a b")], [])


def test_drawn_documents_keep_their_columns(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30)), i % 3) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, score int")
    target = spark.createDataFrame([("w1 w2 w3 w4 w5",)], "text string")
    want = {r.doc_id for r in importance_resampling.digest(d, target).where("rank is not null").collect()}
    got = importance_resampling.resample(d, target)
    assert got.columns == d.columns and len(want) == 10
    assert sorted(tuple(r) for r in got.collect()) == sorted(x for x in docs if x[0] in want)


def test_the_target_is_drawn_towards(spark):
    """Half of the documents are of the target's words: the first ranks are theirs."""
    rng = random.Random(8)
    words = [[f"{k}{i}" for i in range(40)] for k in "ab"]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words[i % 2], k=40))) for i in range(400)], "doc_id bigint, text string")
    target = spark.createDataFrame([(" ".join(rng.choices(words[0], k=40)),) for _ in range(20)], "text string")
    assert all(r.doc_id % 2 == 0 for r in importance_resampling.digest(docs, target).where("rank is not null").collect())


# -- vector codes


def slow_codes(rows):
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    step = len(kept[0][1]) // 16
    v = [[[math.floor(256 * x) for x in r[1][p * step : (p + 1) * step]] for p in range(16)] for r in kept]
    books = [[v[i][p] for i in range(min(64, len(v)))] for p in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            own = [[] for _ in books[p]]
            for x in v:
                own[near(x[p], books[p])[1]].append(x[p])
            books[p] = [[sum(c) // len(c) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for r, x in zip(kept, v, strict=True):
        found = [near(x[p], books[p]) for p in range(16)]
        out.append([r[0], "".join(f"{i:02x}" for _, i in found), min(sum(d for d, _ in found), 2**63 - 1), r[2]])
    total = {}
    for o in out:
        total[o[3]] = min(total.get(o[3], 0) + o[2], 2**63 - 1)
    return sorted(((o[0], o[1], o[2], total[o[3]], sha) for o in out), key=repr)


def codes(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumns({n: F.lit(1) for n in ("vec", "code", "error", "part", "_label")})
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in vector_codes.digest(df).collect()), key=repr)


def single(x):
    return float(np.float32(x))


def test_codes_are_the_slow_ones(spark):
    rng = random.Random(3)
    rows = [(i * 3 - 50, [single(rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 0.2)])) for _ in range(32)], rng.choice([None, 1, 2])) for i in range(400)]
    rows += [(5000, rows[9][1], 1), (5000, rows[9][1], 1), (None, rows[11][1], None), (-50, rows[70][1], 2)]
    rows += [(1, None, 1), (2, [], 1), (3, [None] * 32, 1), (4, [float("nan")] * 32, 1), (6, [float("-inf")] + [0.0] * 31, 2), (7, [0.5] * 16, 1)]
    assert codes(spark, rows) == slow_codes(rows)


def test_codes_of_large_numbers_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [single(rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 5, 20, 38])) for _ in range(16)], i % 2) for i in range(150)]
    assert codes(spark, rows) == slow_codes(rows)


def test_few_vectors_and_none(spark):
    rows = [(i, [single(0.1 * i + 0.01 * k) for k in range(16)], 1) for i in range(5)]
    assert codes(spark, rows) == slow_codes(rows)
    assert codes(spark, []) == []
    with pytest.raises(ValueError, match="equal parts"):
        codes(spark, [(1, [0.5] * 17, 1)])


@given(st.integers(1, 64), st.integers(1, 5), st.sampled_from([3, 50, 10**6, 10**20]), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_kd_tree_finds_the_least_of_the_nearest(entries, width, span, rng):
    book = [[rng.randrange(-span, span) for _ in range(width)] for _ in range(entries)]
    points = [[rng.randrange(-span, span) for _ in range(width)] for _ in range(40)] + book
    index, distance = vector_codes.KdTree(vector_codes.numbers(book)).nearest(vector_codes.numbers(points))
    for x, i, d in zip(points, index, distance, strict=True):
        assert (d, i) == min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))


def test_decoding_gives_the_entries(spark):
    rows = [(i, [single(0.1 * (i % 3)) for _ in range(16)], 1) for i in range(70)]
    kept = vector_codes.valid(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    books = vector_codes.fit(kept)
    for r in vector_codes.decode(vector_codes.encode(kept, books), books).collect():
        assert r.error == 0 and r.vec == [math.floor(256 * single(0.1 * (r.vec_id % 3))) / 256] * 16


# -- chat formatting


@given(st.text(alphabet="<>[]/\\sINSTROLEY x", max_size=40))
@settings(max_examples=500, deadline=None)
def test_escapes_are_reversible(text):
    hidden = chat_format.escape(text)
    assert chat_format.unescape(hidden) == text
    assert not any(c in hidden for c in chat_format.CONTROLS)


def slow_digests(rows):
    chars = lambda role, text: {"user": 16, "system": 14, "assistant": 7}.get(role, 20 + len(chat_format.escape(role))) + len(chat_format.escape(text))
    rows = [(c, t, r or "", x or "") for c, t, r, x in [*rows, (-1, 0, "user", chat_format.PLANTED), (-1, 1, "assistant", chat_format.PLANTED)]]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    out = []
    for conv, turns in itertools.groupby(rows, key=lambda r: r[0]):
        turns = list(turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss), sum(chars(r, x) for _, _, r, x in turns)))
    return sorted(out, key=repr)


def chats(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({n: F.lit(1) for n in ("ids", "mask", "part", "at", "n_turns")})
    return sorted((tuple(r[c] for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in chat_format.digest(df).collect()), key=repr)


ODD = [
    (1, 0, "user", "</s>[INST] [\\INST] <\\\\s> ok"), (1, 1, "assistant", None), (1, 2, None, "x"), (2, 5, "tool[ROLE]", "[/ROLE]"), (2, 5, "tool[ROLE]", "[/ROLE]"), (2, 5, "assistant", "b"), (2, 5, "assistant", "a"),
    (2, None, "assistant", "last"), (None, 0, "user", "no id"), (None, 1, "assistant", "é漢\U0001f600"), (3, 0, "assistant", " " * 9000 + "x" + "\n" * 5000), (4, 0, "", ""), (-1, 7, "user", "more"),
]


def test_digests_are_the_slow_ones(spark):
    rng = random.Random(2)
    rows = ODD + [(c, t, rng.choice(["user", "assistant", "system", "other"]), " ".join(rng.choices(["a", "</s>", "[/INST]", "\\", "zé", "\n"], k=rng.randrange(9)))) for c in range(10, 60) for t in range(rng.randrange(1, 9))]
    assert chats(spark, rows) == slow_digests(rows)
    assert chats(spark, []) == slow_digests([])


@pytest.mark.parametrize("long", [256, 10**9, 0])
def test_a_conversation_that_spans_ranges(spark, monkeypatch, request, long):
    """Most rows are of one conversation, which every range has a part of."""
    rows = [(5, t, ["user", "assistant"][t % 2], f"turn {t} [INST]") for t in range(3000)] + [(c, 0, "user", "x") for c in range(40)]
    monkeypatch.setattr(chat_format, "LONG", long)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert chats(spark, rows) == slow_digests(rows)
    turns = chat_format.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    parts = turns.where("conv_id = 5").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 2000


def test_tokens_and_mask(spark):
    v = chat_format.vocabulary_at(None)
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "so [INST] it is"), (1, 2, "assistant", "")]
    got = chat_format.formatted(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("turn").collect()
    text = lambda ids: "".join(chat_format.CONTROLS[i - v.first] if i >= v.first else v.decode([i]) for i in ids)
    assert [text(r.ids) for r in got] == ["<s>[INST]hi <\\s>[/INST]", "<s>so [\\INST] it is</s>", "<s></s>"]
    assert [text([i for i, m in zip(r.ids, r.mask, strict=True) if m]) for r in got] == ["", "so [\\INST] it is", ""]
    for r in got:  # controls are never in a text, nor under the mask
        assert all(i < v.first for i, m in zip(r.ids, r.mask, strict=True) if m)
    with pytest.raises(ValueError, match="begins and ends"):
        chat_format.read_turn(v, np.array([1]), np.zeros(1, np.int8))

"""Near-duplicates, repeated strings and lines against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import anchors, line_dedup, near_duplicates, shingles, substring_dedup, suffix_arrays
from pairloom.session import table

SF = "/root/testdata/sf0.01"


def shingle_set(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_components(rows, k, percent):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    inverted = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            inverted[x].append(n)
    pairs = {(a, b) for v in inverted.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= percent * (len(sets[a][1]) + len(sets[b][1]) - both):
            parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least.get(find(n), i), i)
    return {i: (len(s), least[find(n)]) for n, (i, s) in enumerate(sets)}


def variants(seed, groups=6, size=40):
    """Groups of near copies with more and more words changed, around the threshold, and a shared passage."""
    rng, rows = random.Random(seed), []
    passage = " ".join(f"p{i}" for i in range(30))
    for g in range(groups):
        base = [f"w{g}_{rng.randrange(400)}" for _ in range(60 + 20 * g)]
        for c in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 8)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words) + (" " + passage if c % 3 == 0 else "")))
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_components_against_brute_force(spark, make_docs, k, percent):
    rows = variants(k) + [(1000, "one two"), (1001, "ONE  two\n"), (1002, "one two three"), (1003, ""), (1004, "lonely")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.digest(make_docs(rows), k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_components_of_the_driver_documents(spark):
    docs = table(spark, SF, "documents").limit(400)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows, 3, 85)


def test_blocks_and_leftover_lists_change_nothing(spark, make_docs, monkeypatch):
    rows = variants(9, groups=3, size=50)
    for name, value in (("BLOCK_CLASSES", 7), ("PAIR_BLOCK", 5), ("ROUNDS", 1), ("BIT_ROWS", 2)):
        monkeypatch.setattr(near_duplicates, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.digest(make_docs(rows)).collect()}
    assert got == brute_components(rows, 3, 85)


@pytest.mark.parametrize("seed", [1, 2])
def test_large_canopies_by_differences(spark, make_docs, monkeypatch, seed):
    """Spread-out variants: many are not linked with the pivot, some with each other only."""
    rng, rows = random.Random(seed), []
    base = [f"w{rng.randrange(300)}" for _ in range(90)]
    for _ in range(6):  # families around variants of their own
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"y{rng.randrange(10**6)}"
        for _ in range(25):
            words = list(own)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    monkeypatch.setattr(near_duplicates, "BLOCK_CLASSES", 10)
    monkeypatch.setattr(near_duplicates, "PAIR_BLOCK", 6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.digest(make_docs(rows)).collect()}
    assert got == brute_components(rows, 3, 85) and len({c for _, c in got.values()}) > 3


def test_one_of_each_group_stays(spark, make_docs):
    rows = variants(4, groups=2, size=10)
    kept = near_duplicates.drop_copies(make_docs(rows))
    want = {c for _, c in brute_components(rows, 5, 80).values()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == make_docs([]).columns


def test_one_of_twin_rows_stays(spark, make_docs):
    rows = [(1, "one text of a few words")] * 5 + [(2, "one text of a few words"), (3, None), (3, None), (4, ""), (1, "another text with the same id")]
    kept = sorted((r.doc_id, r.text or "") for r in near_duplicates.drop_copies(make_docs(rows)).collect())
    assert kept == [(1, "another text with the same id"), (1, "one text of a few words"), (3, ""), (4, "")]


def test_shingle_counts_and_equality():
    texts = ["", None, "a", "A b", "x y z x y z x y z", " \x1c b c", "é É é"]
    got = list(shingles.shingle_sets(texts, 3))
    assert [len(g) for g in got] == [len(shingle_set(t, 3)) for t in texts]
    big = ["word " * 10 + f"tail{i} end fin" for i in range(3000)]
    assert [len(g) for g in shingles.shingle_sets(big, 3)] == [len(shingle_set(t, 3)) for t in big]


# ---------------------------------------------------------------- repeated strings


def brute_strings(rows, length=200):
    counts = Counter(d[i : i + length] for _, d in rows for i in range(len(d) - length + 1))
    out = {}
    for key, d in rows:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[key] = (len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def string_rows(seed=1):
    rng = random.Random(seed)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    a, b = noise(300), noise(500)
    rows = [a, noise(50) + a + noise(50), b[:199], b[:200], b[:201] + noise(20), noise(120) + b[100:420], b, b, "z" * 700, "ab" * 350, noise(1000), a[:150] + b[:150], a[:150] + b[:150] + a[:150] + b[:150], a[10:290] + "\x00" + b[5:480]]
    for i in range(60):  # one passage between different neighbours, cut differently
        rows.append(noise(rng.randrange(40)) + b[rng.randrange(60) : 500 - rng.randrange(60)] + noise(rng.randrange(40)))
    return list(enumerate(rows))


@pytest.mark.parametrize("split,parts", [(2048, 4), (8, 99), (8, 2), (2, 1)])
def test_strings_against_brute_force(spark, make_docs, monkeypatch, split, parts):
    """Whole anchors; anchors over shards that are merged; anchors told apart by longer strings."""
    monkeypatch.setattr(substring_dedup, "SPLIT_CONTEXTS", split)
    monkeypatch.setattr(substring_dedup, "MOST_PARTS", parts)
    rows = string_rows()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.digest(make_docs(rows)).collect()}
    assert got == brute_strings([(i, t.encode()) for i, t in rows])


def test_kept_bytes(spark, make_docs):
    rows = [(1, "q" * 5 + "0123456789" * 30), (2, "0123456789" * 30 + "r")]
    got = {r.doc_id: bytes(r.kept_bytes) for r in substring_dedup.remove_repeats(make_docs(rows)).collect()}
    assert got == {1: b"qqqqq", 2: b"r"}


def test_places_of_twins_are_gathered_once(spark, make_docs):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh ") for _ in range(20_000))
    rows = [(1, text)] * 200 + [(2, text[:5000] + "x" + text[5000:]), (3, "short")]
    docs = make_docs(rows)
    runs = {r.n for r in substring_dedup.repeated_runs(docs.select("doc_id", "text")).selectExpr("size(whole) as n").collect()}
    assert max(runs) < 1000  # one list for all twins, of a text's own places
    got = substring_dedup.digest(docs).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got} == {(1, 20000, 20000, 1), (2, 20001, 20000, 2), (3, 5, 0, 0)} and len(got) == 202


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    for n, width, letters in ((1, 1, 2), (30, 6, 2), (50, 4, 3), (40, 22, 1)):
        words = rng.integers(0, letters, (n, width)).astype(np.uint64)
        rank = suffix_arrays.refine(words)
        suffixes = [tuple(words[i, j:]) for i in range(n) for j in range(width)]
        order = sorted(suffixes)
        assert [order.index(s) for s in suffixes] == rank.tolist()
        array, common = suffix_arrays.kasai(words, rank)
        for k in range(1, len(array)):
            x, y = suffixes[array[k - 1]], suffixes[array[k]]
            assert common[k] == next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))


def test_leftmost_minima_against_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(300):
        h = rng.integers(0, rng.choice([2, 3, 1000]), rng.integers(1, 200)).astype(np.uint64)
        span = int(rng.integers(1, 20))
        assert anchors.leftmost_minima(h, span).tolist() == sorted({i + int(np.argmin(h[i : i + span])) for i in range(len(h) - span + 1)})


# ---------------------------------------------------------------- lines


def brute_lines(rows, size=3):
    seen, out = set(), {}
    for key, text in sorted(rows):
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - size + 1):
            window = tuple(lines[i : i + size])
            if window in seen:
                gone |= set(range(i, i + size))
            seen.add(window)
        out[key] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_lines_against_brute_force(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["", "a", "b", "c c", "é"]) for _ in range(rng.randrange(1, 12)))) for i in range(120)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_repeats(make_docs(rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_of_twin_rows(spark, make_docs):
    text = "\n".join(f"line {i}" for i in range(40))
    docs = make_docs([(2, text)] * 3 + [(3, text), (4, "a\nb"), (4, "a\nb"), (5, None), (5, None)]).withColumn("extra", F.lit("x"))
    out = line_dedup.remove_repeats(docs)
    got = sorted((r.doc_id, r.n_lines, r.n_removed, r.text or "") for r in out.collect())
    assert got == [(2, 40, 0, text), (2, 40, 40, ""), (2, 40, 40, ""), (3, 40, 40, ""), (4, 2, 0, "a\nb"), (4, 2, 0, "a\nb"), (5, 0, 0, ""), (5, 0, 0, "")]
    assert out.where("extra <> 'x'").count() == 0


def test_lines_run_without_python(spark, capsys):
    line_dedup.digest(table(spark, SF, "documents")).explain("formatted")
    plan = capsys.readouterr().out
    assert not re.search("Python|Arrow|Pandas", plan)


def templates(seed, n, common=200, own=85, linked=0):
    """Documents that are mostly one text, each with words of its own; some in pairs that are linked."""
    rng = random.Random(seed)
    text = [f"t{i}" for i in range(common)]
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(10**9)}" for _ in range(own)]
        rows.append((len(rows), " ".join(text + words)))
        if i < linked:
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(own)] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(text + words)))
    return rows


@pytest.mark.parametrize("common,own", [(200, 85), (120, 85), (200, 30), (90, 85)])
def test_documents_of_mostly_one_text(spark, make_docs, common, own):
    rows = templates(common + own, 150, common, own, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.digest(make_docs(rows)).collect()}
    assert got == brute_components(rows, 3, 85)


def test_rows_of_templates_stay_in_proportion(spark):
    """Of thousands of them no list is left to be compared pair by pair."""
    from pairloom.session import Scratch

    docs = spark.createDataFrame(templates(1, 3000), "doc_id bigint, text string").repartition(8)
    scratch = Scratch(spark)
    rows = near_duplicates.sketched(docs, 3)
    classes = scratch.settle(rows.selectExpr("c", "doc_id as low", "k1", "k2", "sketch", "n"), "classes")
    members = near_duplicates.canopies(classes, 85, scratch)
    # each of some seven lists, in three rounds at most
    assert members.count() < 3000 * 21
    left = [p for p in scratch.paths if "nd-left" in p]
    assert not left or spark.read.parquet(left[0]).count() < 300
    scratch.clear()


def test_estimates_of_many_pairs(spark):
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(120, rng.integers(1, 49), replace=False)) for _ in range(60)] + [np.array([2**63 - 1, 5])]
    sets[-1].sort()
    filled = np.full((61, 48), 2**63 - 1)
    for r, s in zip(filled, sets, strict=True):
        r[: len(s)] = s
    x, y = np.triu_indices(61, 1)
    for least in (0.2, 0.45, 0.57):
        got = near_duplicates.similar(filled, np.array([len(s) for s in sets]), x, y, least)
        for a, b, g in zip(x, y, got, strict=True):
            union = np.union1d(sets[a], sets[b])[:48]
            assert g == (len(np.intersect1d(union, np.intersect1d(sets[a], sets[b]))) >= least * len(union))


def test_twins_keep_their_own_columns(spark):
    """Three twins of different source, two of them alike; the same rows however they are dealt."""
    text = "a\nb\nc\nd"
    rows = [(1, text, "s1"), (1, text, "s2"), (1, text, "s2"), (2, "x\na\nb\nc\ny", "s3"), (3, None, "s4"), (3, None, "s5"), (4, "p\nq", "s6"), (4, "p\nq", "s7")]
    seen = set()
    for parts in (1, 3, 8):
        df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts)
        got = sorted(((r.doc_id, r.source, r.text, r.n_lines, r.n_removed) for r in line_dedup.remove_repeats(df).collect()), key=str)
        assert sorted(r[1] for r in got) == ["s1", "s2", "s2", "s3", "s4", "s5", "s6", "s7"]
        assert sorted(r[2] for r in got if r[0] == 1) == ["", "", text]
        assert [r[2] for r in got if r[0] == 2] == ["x\ny"]
        assert [r[2] for r in got if r[0] == 4] == ["p\nq"] * 2
        seen.add(tuple(got))
    assert len(seen) == 1

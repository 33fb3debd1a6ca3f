"""Language identification, quality rules, toxicity, personal data: brute force or held-out accuracy."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pairloom.llm import language_id, pii, quality_divergence, toxicity
from pairloom.session import Scratch, table

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_languages_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    got = language_id.identify_held_out(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert held[0] >= 0.99 and held[1] > 100
    assert got.where("score < 0 or score > 1").count() == 0


def test_grams_against_counting():
    keys, counts = language_id.grams("Ab, ab! é1")
    plain = " ab ab é "
    want = Counter(g for n in (1, 2, 3) for i in range(len(plain) - n + 1) if (g := plain[i : i + n]) != " ")
    decode = lambda k: "".join(chr(k >> s & 0x1FFFFF) for s in (42, 21, 0) if k >> s & 0x1FFFFF)
    assert {decode(int(k)): int(c) for k, c in zip(keys, counts)} == want


def brute_languages(rows, held, size):
    """Profiles by counting, out-of-place distances by the definition."""
    count = lambda t: Counter(g for p in [" " + " ".join(regex.findall(r"[\p{L}\p{M}]+", t.lower())) + " "] for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]) != " ")
    order = lambda c: sorted(c, key=lambda g: (-c[g], [ord(g[-k]) if k <= len(g) else 0 for k in (3, 2, 1)]))[:size]
    profiles = {}
    for g in sorted({r[2] for r in rows if r[2]}):
        total = sum((count(t) for i, t, lang in rows if lang == g and t and regex.search(r"\p{L}", t) and i not in held), Counter())
        if total:
            profiles[g] = {x: k for k, x in enumerate(order(total))}
    out = {}
    for i, t, _ in rows:
        if not t or not regex.search(r"\p{L}", t):
            out[i] = ("und", 0.0)
            continue
        mine = order(count(t))
        far = {g: sum(abs(p[x] - k) if x in p else size for k, x in enumerate(mine)) for g, p in profiles.items()}
        best = min(far, key=lambda g: (far[g], g))
        out[i] = (best, 1 - far[best] / (size * len(mine)))
    return out


def test_languages_against_brute_force(spark, make_docs):
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, SMALL, "documents").limit(120).collect()]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !", "fr"), (1003, "word", None), (1004, "ñandú é", "es"), (1005, "ñandú é", "es")]
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    got = {r.doc_id: (r.lang_pred, pytest.approx(r.score)) for r in language_id.identify_held_out(make_docs(rows)).collect()}
    assert got == brute_languages(rows, held, language_id.PROFILE_SIZE)


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words)


def test_base_rules_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect() + [type("R", (), {"doc_id": -1, "text": "a b c a b c\nx\x1cy é\nx\x1cy é\n\n"})()]
    for r in docs:
        data = r.text.encode()
        assert quality_divergence.base_features(data, data.split()) == brute_base(r.text)


def test_junk_is_dropped_and_clean_text_kept(spark):
    docs = table(spark, SF, "documents")
    got = quality_divergence.assess(docs).join(table(spark, SF, "labels"), "doc_id").where("not base_failed")
    rates = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rates[1] >= 0.99 and rates[0] <= 0.05


def brute_quality(rows):
    """Distances, limits and verdicts by plain counting. ``rows`` are (id, text, lang)."""
    q, log = quality_divergence, lambda p, m: p * np.log2(p / m) if p else 0.0
    facts = {i: (brute_base(t or ""), (t or "").encode(), g) for i, t, g in rows}
    bucket = lambda w: zlib.crc32(w.strip(q.EDGES)) % q.BUCKETS
    chars = lambda d: Counter(c for c in (int(q.TABLE[b]) for b in d) if c < len(q.CLASSES))
    words = lambda d: Counter(bucket(w) for w in d.lower().split())
    langs = sorted({g for b, _, g in facts.values() if not b[-1] and g})
    refs = {g: (sum((chars(d) for b, d, h in facts.values() if h == g and not b[-1]), Counter()), sum((words(d) for b, d, h in facts.values() if h == g and not b[-1]), Counter())) for g in langs}

    def far(p, r):
        sp, sr = max(sum(p.values()), 1), max(sum(r.values()), 1)
        m = {k: (p[k] / sp + r[k] / sr) / 2 for k in {*p, *r}}
        return np.sqrt(max(0.0, sum(log(p[k] / sp, m[k]) + log(r[k] / sr, m[k]) for k in m) / 2))

    out = {}
    for i, (base, data, lang) in facts.items():
        found = []
        for g in [lang] if lang in refs else langs:
            top = {k for k, _ in sorted(refs[g][1].items(), key=lambda x: (-x[1], x[0]))[: q.COMMON]}
            fold = lambda c: Counter({k: v for k, v in c.items() if k in top}) + Counter({-1: sum(v for k, v in c.items() if k not in top)})  # noqa: B023, E731
            found.append((far(fold(words(data)), fold(refs[g][1])), far(chars(data), refs[g][0]), g))
        w, c, g = min(found) if found and not base[-1] else (None, None, None)
        out[i] = [base[-1], c if c is not None and len(data.decode()) >= q.GUARD_CHARS else None, w if w is not None and base[0] >= q.GUARD_WORDS else None, g, min(12, max(5, int(np.log2(max(base[0], 1)))))]
    limits, usual = {}, {}
    for k in (1, 2):
        groups = defaultdict(list)
        for r in out.values():
            if r[k] is not None:
                groups[r[3], r[4]].append(int(r[k] * q.BINS))
        usual[k] = {g: sorted(v)[(len(v) - 1) // 2] for g, v in groups.items()}
        excess = sorted(x - usual[k][g] for g, v in groups.items() for x in v)
        best, limits[k] = 0.0, None
        for cut in sorted(set(excess))[:-1]:
            lo, hi = [x for x in excess if x <= cut], [x for x in excess if x > cut]
            between = len(lo) * len(hi) * (np.mean(hi) - np.mean(lo)) ** 2
            if between > best * (1 + 1e-12):
                best, limits[k] = between, (cut + 0.5) / q.BINS if np.mean(hi) - np.mean(lo) >= q.LEAST_GAP * q.BINS else None
    kept = lambda r: not r[0] and not any(limits[k] is not None and r[k] is not None and r[k] - (usual[k][r[3], r[4]] + 0.5) / q.BINS > limits[k] for k in (1, 2))
    return {i: (r[1], r[2], kept(r)) for i, r in out.items()}


def test_distances_and_verdicts_against_brute_force(spark, make_docs, odd_rows):
    rows = [(r.doc_id, r.text, r.lang if r.doc_id % 40 else None) for r in table(spark, SF, "documents").where("length(text) < 4000").limit(300).collect()]
    rows += [(10_000 + i, None if i == 1 else "", "en") for i in range(3)] + [(20_000, "мир и труд " * 60 + "конец слова дело жизнь", "ru")]
    got = {r.doc_id: r for r in quality_divergence.assess(make_docs(rows)).collect()}
    for i, (chars, words, kept) in brute_quality(rows).items():
        assert (got[i].char_distance, got[i].word_distance) == (pytest.approx(chars), pytest.approx(words)) and got[i].kept == kept, i
    assert len({r.kept for r in got.values()}) == 2


def test_nobody_fails_without_a_second_group():
    assert quality_divergence.best_cut({b: 100 - abs(b) for b in range(-90, 91)}) is None and quality_divergence.best_cut({3: 5}) is None
    assert 0.1 < quality_divergence.best_cut({**{b: 100 for b in range(-50, 51)}, **{b: 10 for b in range(280, 300)}}) < 0.28


def test_divergence_bounds():
    p = np.array([1.0, 0.0])
    assert quality_divergence.divergence(p, np.array([[1.0, 0.0], [0.0, 3.0]])).tolist() == [0.0, 1.0]


def test_toxicity_of_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = toxicity.detect(docs, labels).join(labels, "doc_id").where("held_out")
    r = {x.toxic: x.p for x in got.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    # 33 toxic rows to learn from, in four languages with words of their own; on 2,162 the recall is 0.99
    assert r[0] <= 0.02 and r[1] >= 0.5


def test_sample_drops_copies_only(spark, make_docs):
    # every text has the same long words, so any of them could evict another before
    rows = [(i, f"shared wording everywhere nr {i}") for i in range(40)]
    rows += [(100 + i, "Shared  wording EVERYWHERE nr 0") for i in range(3)] + [(200, "shared wording everywhere nr 1")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(100, 1), (101, 1), (102, 1), (200, 1)], "doc_id bigint, toxic int")
    got = Counter(r.toxic for r in toxicity.training_sample(make_docs(rows), labels, F.lit(True)).collect())
    assert got == {1: 11, 0: 30}  # nr 0 once; nr 1 is clean and toxic
    assert Counter(r.toxic for r in toxicity.training_sample(make_docs(rows), labels, F.lit(True), 8).collect()) == {0: 8, 1: 8}


def test_scores_do_not_see_labels_language_source_or_id(spark):
    docs, labels = table(spark, SF, "documents").limit(300), table(spark, SF, "labels")
    model = ({"wbad": 5.0}, -2.0)
    a = toxicity.score(docs.select("doc_id", "text"), model, ("doc_id",)).collect()
    b = toxicity.score(docs.select((F.col("doc_id") + 1).alias("doc_id"), "text"), model, ("doc_id",)).collect()
    assert [x.score for x in a] == [x.score for x in b]
    del labels


def votes_of(columns):
    row, column = np.nonzero(np.column_stack(columns))
    return row, column


def noisy_votes(rng, truth, hit, false):
    return rng.random(len(truth)) < np.where(truth == 1, hit, false)


def test_posterior_corrects_wrong_labels():
    rng = np.random.default_rng(0)
    truth = (rng.random(4000) < 0.3).astype(int)
    row, column = votes_of([noisy_votes(rng, truth, 0.3, 0.002) for _ in range(12)])  # rare entries, as lexicons have them
    given = np.where(rng.random(4000) < 0.2, 1 - truth, truth)
    post = toxicity.label_model(4000, row, column, given.astype(float))
    assert (given == truth).mean() < 0.82 and ((post > 0.5) == truth).mean() > 0.95


def test_label_model_shares_weight_of_copies():
    rng = np.random.default_rng(1)
    truth = (rng.random(4000) < 0.3).astype(int)
    single = [noisy_votes(rng, truth, 0.3, 0.002) for _ in range(12)]
    weak = noisy_votes(rng, truth, 0.4, 0.15)
    alone = weak & ~np.any(single, axis=0)
    given = np.where(rng.random(4000) < 0.2, 1 - truth, truth).astype(float)
    once = toxicity.label_model(4000, *votes_of([*single, weak]), given)[alone].mean()
    often = toxicity.label_model(4000, *votes_of([*single, *[weak] * 8]), given)[alone].mean()
    assert often < once + 0.1  # eight copies of a weak voter say little more than one


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_against_the_plain_patterns(spark):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("ab@.1 2_+-%9(5)é"), rng.integers(0, 60))) for _ in range(20000)]
    made += ["4111 1111 1111 1111 x +1 (555) 010-9999 a@b.c_x@d.e 1.2.3.4.5.6.7.8 256.1.1.1"] + [r.text for r in table(spark, SF, "documents").collect()]
    for text in made:
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    pii.base_spans("a" * 200_000 + "1" * 200_000 + "@" * 1000 + "." * 1000)


def test_contexts_find_unseen_identifiers(spark, make_docs):
    rows = [(i, f"hello please write to user{i}@mail{i}.org today") for i in range(12)]
    rows += [(100 + i, f"hello please write to staff-{i}70011 today") for i in range(3)] + [(200 + i, f"chapter number {i}70011 begins") for i in range(9)]
    got = {r.doc_id: r for r in pii.digest(make_docs(rows)).collect()}
    assert all(got[100 + i].n_more == 1 and got[100 + i].spans == f"email:22:{22 + len(f'staff-{i}70011')}" for i in range(3))
    assert all(got[200 + i].n_more == 0 for i in range(9)) and all(got[i].n_email == 1 for i in range(12))


def test_contexts_find_words_without_digits_and_runs_of_groups(spark, make_docs):
    rows = [(i, f"hello please write to user{i}@mail{i}.org today") for i in range(12)]
    rows += [(50 + i, f"or you ring me on +44 20 7946 {1000 + i}, thanks") for i in range(12)]
    odd = ["jane.doe(at)corp.example", "bob@localhost"]
    rows += [(100 + i, f"hello please write to {w} today") for i, w in enumerate(odd)]
    runs = ["020 7946 0958", "(555) 010-9999"]
    rows += [(200 + i, f"or you ring me on {w}, thanks") for i, w in enumerate(runs)]
    got = {r.doc_id: r for r in pii.digest(make_docs(rows)).collect()}
    assert [got[100 + i].spans for i in range(2)] == [f"email:22:{22 + len(w)}" for w in odd]
    assert [got[200 + i].spans for i in range(2)] == [f"phone:18:{18 + len(w)}" for w in runs]
    assert all(got[i].n_more == 0 for i in [*range(12), *range(50, 62)])


def test_secrets_are_found_by_context(spark):
    docs = table(spark, SF, "documents")
    got = pii.digest(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in got:
        want = {(m.start(1), m.end(1)) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text)}
        assert {(int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x) if k == "secret"} == want
    assert sum(r.n_more for r in got) > 0 and all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_more for r in got)


def brute_graph(patterns, edges, total, rounds):
    """Scores of patterns and instances by plain loops."""
    inst = {i: 0.0 for _, i, _ in edges}
    for _ in range(rounds):
        score = {p: (n + sum(inst[i] for q, i, _ in edges if q == p)) / (n + sum(q == p for q, _, _ in edges)) for p, (_, _, n) in patterns.items()}
        inst = {i: min(1.0, max(sum(n * score[p] for p, j, n in edges if j == i and patterns[p][0] == side) / total[i] for side in "lr")) for i in inst}
    return score, inst


def test_graph_scores_against_loops(spark):
    rng = np.random.default_rng(2)
    patterns = {p: ("lr"[p % 2], "email", int(rng.integers(2, 9))) for p in range(12)}
    edges = [(p, i, int(rng.integers(1, 4))) for p in range(10) for i in range(40) if rng.random() < 0.2]
    total = {i: sum(n for _, j, n in edges if j == i) + int(rng.integers(0, 5)) for _, i, _ in edges}
    rows = spark.createDataFrame([(p, *v) for p, v in patterns.items()], "pattern bigint, side string, kind string, n_seeds bigint")
    got, inst = pii.bootstrap(rows, spark.createDataFrame(edges, "pattern bigint, instance bigint, n bigint"), spark.createDataFrame(list(total.items()), "instance bigint, total bigint"), Scratch(spark), 3)
    want, wanted = brute_graph(patterns, edges, total, 3)
    assert {r.pattern: r.score for r in got.collect()} == pytest.approx(want) and {r.instance: r.score for r in inst.collect()} == pytest.approx(wanted)


def test_common_words_after_a_trusted_pattern_stay(spark, make_docs):
    rows = [(i, f"please write to user{i}@mail{i}.org today") for i in range(12)]
    rows += [(50, "please write to us today")] + [(100 + i, f"nobody asked us about it, word{i}") for i in range(20)] + [(70, "please write to qx-77-zed today")]
    got = {r.doc_id: r for r in pii.digest(make_docs(rows)).collect()}
    assert got[50].n_more == 0 and got[70].spans == "email:16:25"


def test_copies_are_one_piece_of_evidence(spark, make_docs):
    rows = [(i, "an odd context for a.b@c.org it is") for i in range(20)] + [(100, "an odd context for something7 it is")]
    assert {r.n_more for r in pii.digest(make_docs(rows)).collect()} == {0}


def test_candidates_take_linear_time():
    text = ("w " * 20 + "x@y.zz ") * 20_000
    base = pii.base_spans(text)
    assert len(base) == 20_000 and pii.more_seeds(text, base) == []
    assert len(pii.patterns_around(text.encode(), pii.Places(text.encode()), base)) == 20_000

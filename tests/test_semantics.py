"""One small case for each semantic trap, and the reference's own self-checks as assertions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.functions import text as X
from pairloom.functions import vectors as V
from pairloom.operators import aggregates as G
from pairloom.operators import joins as J
from pairloom.operators import nested, quality, rules, windows
from pairloom.operators import registry as R
from pairloom.operators import sampling as S
from pairloom.operators import sets as Z
from pairloom.plans import probes
from pairloom.plans import statistics as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first().x


def test_class_rules_differ(spark):
    row = spark.createDataFrame([("t", None, "valid", "preserved", "sex_specific", "ambiguous", "uncertain")], "text string, reason string, v string, c string, r string, m string, i string")
    args = (F.col("text"), F.col("reason"), F.col("v"), F.col("c"))
    got = row.select(rules.class_summary(*args, F.col("m"), F.col("i")), rules.class_validator(*args, F.col("r"), F.col("i")), rules.class_extract(*args, F.col("r"), F.col("m"), F.col("i")), rules.class_trace(*args, F.col("r"), F.col("i"))).first()
    assert tuple(got) == (None, "class3", "class2", "class2")


def test_majority_ties_keep_the_first_seen(spark):
    rows = spark.createDataFrame([("x", 1, "b"), ("x", 2, "a"), ("y", 1, "a"), ("y", 2, "b"), ("y", 3, "b"), ("z", 1, "b"), ("z", 2, "a"), ("z", 3, "c")], "k string, o int, v string")
    got = {r.k: (r.majority, round(r.majority_frac, 3), r.unanimous, r.n_unique) for r in G.majority(rows, ["k"], "v", "o").collect()}
    assert got == {"x": ("b", 0.5, False, 2), "y": ("b", 0.667, False, 2), "z": ("b", 0.333, False, 3)}


def test_last_wins(spark):
    a = spark.createDataFrame([("q1", "old", 0), ("q2", "two", 1), (None, "lost", 2)], "id string, v string, pos int")
    b = spark.createDataFrame([("q1", "new", 0)], "id string, v string, pos int")
    got = sorted((tuple(r.first_place), r.id, r.v) for r in Z.last_wins([a, b], "id").collect())
    assert got == [((0, 0), "q1", "new"), ((0, 1), "q2", "two")]


@pytest.mark.parametrize("values,upper,middle", [([1.0, 2.0, 3.0, 4.0], 3.0, 2.5), ([5.0, 1.0, 4.0, 2.0, 3.0], 3.0, 3.0)])
def test_upper_median(spark, values, upper, middle):
    r = G.summary(spark.createDataFrame([(v,) for v in values], "x double"), [], "x", upper=True).withColumnsRenamed({"upper_median": "u", "median": "m"}).first()
    assert (r.u, r.m) == (upper, middle)


def test_patterns_are_case_sensitive_on_lowered_text(spark):
    tags = lambda text, group: one(spark, X.tags(F.col("t"), R.AUDIT_PATTERNS[group]), t=("string", text))
    assert tags("takes HRT", "gender_identity") == []
    assert tags("schizophrenia", "disability") == []
    assert one(spark, X.tags_any_case(F.col("t"), R.AUDIT_PATTERNS["gender_identity"]), t=("string", "takes HRT")) == ["hormone_therapy_cue"]


@pytest.mark.parametrize("text,ages,group", [("a 6 month old", [0.5], "infant"), ("45-year-old", [45.0], "middle_aged"), ("an elderly man", [], "elderly"), ("nobody", [], None)])
def test_ages(spark, text, ages, group):
    assert one(spark, X.ages(F.col("t")), t=("string", text)) == ages
    assert one(spark, X.age_group(F.col("t")), t=("string", text)) == group


def test_top_k_padding(spark):
    assert one(spark, A.padded_top_k(F.col("w"), 4), w=("array<double>", [0.1, 0.7, 0.7])) == [1, 2, 0, -1]
    assert one(spark, V.jaccard(V.valid_positions(F.col("a")), V.valid_positions(F.col("b"))), a=("array<int>", [1, -1]), b=("array<int>", [2, -1])) == 0.0
    assert one(spark, V.jaccard(F.col("a"), F.col("b")), a=("array<int>", [1, -1]), b=("array<int>", [2, -1])) == pytest.approx(1 / 3)


@pytest.mark.parametrize("a,b,found", [([1, 2, 3], [1, 9, 3], (1, 2, 2, True)), ([1, 3], [1, 2, 3], (1, 1, 2, False)), ([1, 2, 3], [1, 3], (1, 2, 1, False)), ([1, 2], [1, 2], (2, 2, 2, False))])
def test_spans(spark, a, b, found):
    assert tuple(one(spark, A.edited_span(F.col("a"), F.col("b")), a=("array<int>", a), b=("array<int>", b))) == found
    whole = one(spark, A.edited_span(F.col("a"), F.col("b"), fallback=True), a=("array<int>", a), b=("array<int>", b))
    assert whole.valid or (whole.start, whole.end_a, whole.end_b) == (0, len(a), len(b))


def test_duplicate_pair_keys_do_not_fan_out(spark):
    results = spark.createDataFrame([("p", 1, "a"), ("p", 2, "b")], "k string, o int, v string")
    pairs = spark.createDataFrame([("p",), ("p",)], "k string")
    assert [r.v for r in pairs.join(J.dedupe_last(results, ["k"], ["o"]), "k").collect()] == ["b", "b"]


def test_label_folding_splits_families(spark):
    late = lambda label: one(spark, rules.family_late(F.lit("sex"), F.col("t")), t=("string", label))
    head = lambda label: one(spark, rules.family_heads(F.lit("sex"), F.col("t"), F.lit(None).cast("string")), t=("string", label))
    assert late("non-binary") == late("non binary") == head("non-binary") == "gender_identity"
    assert (late("gender non-conforming"), head("gender non-conforming")) == ("sex_gender", "gender_identity")


@pytest.mark.parametrize("delta,after,expected", [(0.04, 0.0, None), (0.05, 0.0, 1.0), (1.0, -0.5, 1.5), (1.0, 9.0, -3.0), (-1.0, -0.25, 0.75)])
def test_recovery(spark, delta, after, expected):
    got = one(spark, V.recovery(F.col("d"), F.col("a")), d=("double", delta), a=("double", after))
    assert got is None if expected is None else got == pytest.approx(expected, abs=1e-6)


def test_bin_edges_count_twice(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(5)], "x double")
    got = {r.bin: r.n for r in windows.percentile_bins(rows, "x", 2, {"mean": F.col("x")}).collect()}
    assert got == {0: 3, 1: 3}


def test_nan_and_null(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert rows.agg(F.avg(V.skip_nan(F.col("x")))).first()[0] == 1.0
    assert one(spark, V.finite(F.col("v")), v=("array<double>", [1.0, float("nan")])) is False


def test_empty_strings_fall_through(spark):
    assert one(spark, X.first_truthy(F.col("a"), F.col("b")), a=("string", ""), b=("string", "value")) == "value"


def test_alignment_default(spark):
    rows = spark.createDataFrame([(True,), (False,), (None,)], "failed boolean")
    assert rows.where(~F.coalesce("failed", F.lit(True))).count() == 1
    assert rows.where(~F.coalesce("failed", F.lit(False))).count() == 2


def test_side_array_grows(spark):
    v = "array<struct<intervention_type:string,text:string>>"
    got = one(spark, rules.merge_side_array(F.col("m"), F.col("s")), m=(v, [("a", "1")]), s=(v, [("a", "x"), ("c", "y"), ("c", "z")]))
    assert [r.text for r in got] == ["1", "y"]


def test_decomposition_and_directions(spark):
    d1, d2 = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    row = spark.createDataFrame([([3.0, 2.0, 0.0], d1, d2)], "v array<double>, a array<double>, b array<double>")
    parts = row.select(*[c.alias(n) for n, c in V.decompose(F.col("v"), F.col("a"), F.col("b")).items()]).first()
    assert (parts.beta1, parts.beta2) == (3.0, 2.0) and parts.residual_norm < 1e-6
    assert row.select(V.add_direction(F.col("v"), F.col("a"), 0.0)).first()[0] == [3.0, 2.0, 0.0]
    parallel = row.select(*[c.alias(n) for n, c in V.decompose(F.col("v"), F.col("a"), F.col("a")).items()]).first()
    assert (parallel.beta1, parallel.beta2) == (1.5, 1.5)


def test_both_layouts_and_other_payloads(spark):
    raw = spark.createDataFrame([("a", '[{"intervention_type": "sex", "text": "t"}]'), ("b", '{"gender": {"male": {"text": "m"}, "female": {"text": null, "reason_if_null": "identical"}}}'), ("c", '"x"')], "question_id string, raw string")
    records = raw.withColumn("variants", nested.variants_from_json(F.col("raw")))
    rows = sorted((r.question_id, r.intervention_type, r.attribute_value_counterfactual, r.text, r.has_text, r.is_identical) for r in nested.flatten_variants(records).collect())
    assert rows == [("a", "sex", None, "t", True, False), ("b", "gender", "female", None, False, True), ("b", "gender", "male", "m", True, False)]
    counts = {r.question_id: (r.n_variants, r.n_with_text, r.n_null) for r in nested.flatten_questions(records).collect()}
    assert counts == {"a": (1, 1, 0), "b": (2, 1, 1), "c": (0, 0, 0)}


def test_strict_validation_rejects_missing_fields(spark):
    names = {f for f in R.ENUMS_STRICT} | {"intervention_family", "semantic_class", "rationale", "text", "reason_if_null"}
    row = {n: None for n in names} | {"intervention_type": "sex", "annotation_confidence": 1.5}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'double' if n == 'annotation_confidence' else 'string'}" for n in row)).withColumn("id", F.lit(1))
    loose = quality.enum_issues(df, ["id"]).count()
    strict = {r.field for r in quality.strict_issues(df, ["id"], R.intervention_registry(spark)).collect()}
    assert loose == 0 and {"clinical_coherence", "annotation_confidence", "rationale", "reason_if_null", "semantic_class"} <= strict


def test_json_schema_predicates(spark):
    schema = {"properties": {"id": {"type": "string", "pattern": "^q_"}, "m": {"type": "object", "properties": {"age": {"type": ["integer", "null"], "minimum": 0, "maximum": 120}, "sex": {"enum": ["male", "female"]}}, "required": ["age"]}}, "required": ["id"]}
    rows = spark.createDataFrame([(1, '{"id": "q_1", "m": {"age": 5, "sex": "male"}}'), (2, '{"m": {"age": 500, "sex": "x"}}'), (3, '{"id": "z"}')], "k int, j string")
    got = sorted((r.k, r.field, r.message) for r in quality.schema_issues(rows, "j", schema, ["k"]).collect())
    assert got == [(2, "id", "missing"), (2, "m.age", "above maximum"), (2, "m.sex", "not in enumeration"), (3, "id", "pattern")]


def test_splits_leak_no_group(spark):
    rows = S.group_split(spark.range(2000).withColumn("g", F.col("id") % 97), "g", 0.3)
    assert rows.groupBy("g").agg(F.count_distinct("is_test").alias("n")).where("n > 1").count() == 0
    assert 0.1 < rows.agg(F.avg(F.col("is_test").cast("int"))).first()[0] < 0.5


def test_registry_tiers():
    assert R.resolve_tiers(["3", "1", "x"]) == ["1", "3a", "3b", "x"]
    assert set(R.CONTROLS) <= set(R.tier_types(["2"])) and "sex" not in R.tier_types(["2"])


def test_fingerprint():
    quality.check_fingerprint(None, {"a": 1})
    quality.check_fingerprint(quality.fingerprint({"a": 1, "b": 2}), {"b": 2, "a": 1})
    with pytest.raises(ValueError):
        quality.check_fingerprint(quality.fingerprint({"a": 1}), {"a": 2})


def test_tail_probabilities():
    assert T.beta_inc(5.0, 0.5, 10 / (10 + 2.228139**2)) == pytest.approx(0.05, abs=1e-5)  # t = 2.228139, 10 degrees of freedom
    assert T.beta_inc(2.0, 3.0, 0.4) == pytest.approx(0.5248, abs=1e-4)


def test_average_ranks_of_a_whole_table(spark):
    values = [3.0, 1.0, 3.0, 2.0, 2.0, 2.0, 9.0]
    rows = T.global_rank(spark.createDataFrame([(v,) for v in values], "x double"), "x", "r")
    assert sorted({(r.x, r.r) for r in rows.collect()}) == [(1.0, 1.0), (2.0, 3.0), (3.0, 5.5), (9.0, 7.0)]


def test_bootstrap_and_permutation(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([("g", float(v), i % 2) for i, v in enumerate(rng.normal(5, 1, 400))], "g string, x double, f int")
    b = T.bootstrap(rows, "g", "x", draws=400).first()
    assert b.lo <= b.hi and b.lo < 5.2 and b.hi > 4.8 and b.hi - b.lo < 0.5
    apart = rows.withColumn("x", F.col("x") + 3 * F.col("f"))
    assert T.permutation(apart, "g", "x", F.col("f") == 1, draws=200).first().p == 0.0
    assert T.permutation(rows, "g", "x", F.col("f") == 1, draws=200).first().p > 0.01

def test_permutation_takes_every_row(spark):
    # 30,000 rows, equal (x, f) in blocks; more distinct values than one block holds
    rows = spark.range(30000).select((F.col("id") % 2).cast("int").alias("g"), (F.col("id") % 5).cast("double").alias("x"), (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("f"))
    rows = rows.withColumn("g", F.lit(None).cast("int")).union(rows.limit(100))
    want = rows.where("g is null").agg(F.avg(F.when(F.col("f") == 1, F.col("x"))) - F.avg(F.when(F.col("f") == 0, F.col("x")))).first()[0]
    got = {r.g: r for r in T.permutation(rows, "g", "x", F.col("f") == 1, draws=500).collect()}
    assert got[None].n == 30000 and got[None].difference == pytest.approx(want) and got[0].n + got[1].n == 100
    wide = spark.range(9000).select(F.lit("a").alias("g"), (F.col("id") + F.when(F.col("id") % 2 == 0, 90.0).otherwise(0.0)).alias("x"), (F.col("id") % 2).cast("int").alias("f"))
    a = wide.toPandas()
    d, rng = a.x[a.f == 1].mean() - a.x[a.f == 0].mean(), np.random.default_rng(0)
    plain = np.mean([abs((s := a.x.to_numpy()[rng.permutation(9000)])[:4500].mean() - s[4500:].mean()) >= abs(d) for _ in range(2000)])
    got = T.permutation(wide, "g", "x", F.col("f") == 1, draws=2000).first()
    assert got.n == 9000 and got.difference == pytest.approx(d) and abs(got.p - plain) < 0.05


def test_hypergeometric_above_a_billion():
    rng = np.random.default_rng(1)
    got = T.hypergeometric(rng, 3 * 10**9, 10**9, np.full(4000, 1000))
    assert abs(got.mean() - 750) < 1 and abs(got.std() - np.sqrt(1000 * 0.75 * 0.25)) < 0.6 and T.hypergeometric(rng, 5, 2 * 10**9, np.array([0])).tolist() == [0]


def test_probes_learn_separable_classes(spark):
    rng = np.random.default_rng(1)
    rows = [(i, i % 2, [float(x) for x in rng.normal(3 * (i % 2), 1, 4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, y int, v array<double>").withColumn("layer", F.lit(0))
    m = probes.layer_probes(df, "layer", "v", "y", "id").first()
    assert m.accuracy > 0.9 and m.lift > 0.3 and m.n_train + m.n_test == 200
    assert probes.threshold_probe(df, "v", F.col("y") == 1).first().accuracy > 0.9
    assert probes.leave_one_out(df.where("id < 40"), "layer", "v", "y", 3).first().accuracy > 0.85


def test_leave_one_out_of_a_large_group(spark):
    rng = np.random.default_rng(2)
    rows = [(1, int(i % 3 == 0), [float(v) for v in rng.normal(0, 1, 6) + np.eye(6)[5] * 2 * (i % 3 == 0)]) for i in range(600)]
    got = {r.k: r for r in probes.leave_one_out(spark.createDataFrame([*rows, (2, 1, [0.0] * 6)], "k int, y int, v array<double>"), "k", "v", "y").collect()}
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    z = (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2].T
    z = np.column_stack([z / z.std(axis=0), np.ones(600)])
    hits = 0
    for i in range(600):  # plain Newton, as the objective is
        keep, w = np.arange(600) != i, np.zeros(7)
        for _ in range(12):
            p = 1 / (1 + np.exp(-z[keep] @ w))
            ridge = np.append(np.full(6, 100.0), 0)
            w -= np.linalg.solve((z[keep] * (p * (1 - p))[:, None]).T @ z[keep] + np.diag(ridge), z[keep].T @ (p - y[keep]) + ridge * w)
        hits += (z[i] @ w > 0) == y[i]
    assert got[1].n == 600 and got[1].accuracy == pytest.approx(hits / 600) and hits > 450
    assert got[2].n == 1 and got[2].accuracy is None


def test_ward_recovers_groups(spark):
    rows = [(i, [1.0, 0.1 * i, 0.0]) for i in range(3)] + [(i, [0.0, 0.1 * i, 5.0]) for i in range(3, 6)]
    got = {r.h: r.cluster_2 for r in probes.ward_clusters(spark.createDataFrame(rows, "h int, v array<double>"), "h", "v", (2,)).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2}


def test_edit_functions(spark):
    row = spark.createDataFrame([("a man came", "a woman came"), (None, "x")], "a string, b string")
    got = row.select(X.edit_ratio(F.col("a"), F.col("b")).alias("r"), X.edit_regions(F.col("a"), F.col("b")).alias("g")).collect()
    assert got[0].r == pytest.approx(1 - 2 * 10 / 22) and got[0].g[0].tag == "insert"
    assert got[1].r is None and got[1].g is None


def test_stem_offset_and_token_map(spark):
    tokens = spark.createDataFrame([([9, 1, 2, 3], [1, 2, 3]), ([9, 2, 3], [1, 2, 3]), ([5], [1])], "t array<int>, s array<int>")
    assert [r[0] for r in tokens.select(A.stem_offset(F.col("t"), F.col("s"))).collect()] == [1, 0, None]
    spans = spark.createDataFrame([([0, 2], [2, 3], 4)], "s array<int>, e array<int>, n int")
    assert spans.select(A.char_to_token("s", "e", "n")).first()[0] == [0, 0, 1, -1]


def test_softmax_is_a_distribution(spark):
    p = one(spark, V.softmax(F.col("z")), z=("array<double>", [1000.0, 1001.0, -5.0, 0.0]))
    assert math.isclose(sum(p), 1.0) and max(p) == p[1]


def test_results_do_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([("ab"[i % 2] if i % 11 else None, float(v)) for i, v in enumerate(rng.integers(0, 40, 500))], "g string, x double")
    one = {r.g: (r.lo, r.hi) for r in T.bootstrap(rows.coalesce(1), "g", "x", draws=300).collect()}
    for r in T.bootstrap(rows.repartition(7), "g", "x", draws=300).collect():
        assert (r.lo, r.hi) == pytest.approx(one[r.g])
    want = {}
    for g in ("a", "b", None):
        values = sorted(r.x for r in rows.collect() if r.g == g)
        want |= {(g, v): (values.index(v) + 1 + values.index(v) + values.count(v)) / 2 for v in values}
    got = T.ranked(rows, "x", "rank", ["g"], "ties").collect()
    assert len(got) == 500 and all(r["rank"] == want[r.g, r.x] for r in got)


def test_side_array_without_types(spark):
    v = "array<struct<intervention_type:string,text:string>>"
    got = one(spark, rules.merge_side_array(F.col("m"), F.col("s")), m=(v, [("a", "1")]), s=(v, [(None, "x"), (None, "y")]))
    assert [r.text for r in got] == ["1", "x"]


def test_one_pattern_for_many_tries_those_of_a_word_only(spark):
    """every alternative was tried at every word of a text."""
    import re

    patterns = [*R.AUDIT_PATTERNS["race"].values(), *R.AUDIT_PATTERNS["substance"].values(), *R.STATISTICS_WORDS, *R.ANATOMY_WORDS, r"\bab?c", r"\b(x[|]y|zz)\b", r"\bfoo|bar", "plain"]
    texts = ["white", "awhite", "whites", "african american", "puerto rican x", "drinks per day", "drinks", "ovarian", "a mean, b", "means", "p-value", "ac", "abc", "xy", "x|y", "zz", "foo", "bar", "a bar", "cubar", "explains", "", "of the"]
    want = {t: any(re.search(p if p != r"\bfoo|bar" else r"\b(?:foo|bar)", t) for p in patterns) for t in texts}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.hit for r in rows.select("t", F.col("t").rlike(X.any_of(patterns)).alias("hit")).collect()} == want
    every = X.any_of([p for ps in R.AUDIT_PATTERNS.values() for p in ps.values() if p.isascii()])
    word = every[: every.index("(?:") + 3]
    depth = alternatives = 0
    for c in every[len(word):]:  # those tried at a word that begins with none of their letters
        depth += (c == "(") - (c == ")")
        alternatives += c == "|" and depth == 0
    assert alternatives < 50
    got = spark.createDataFrame([("the mean of a cohort",), ("mean mean",), (None,)], "t string").select(X.hit_count(F.col("t"), R.STATISTICS_WORDS).alias("n"))
    assert [r.n for r in got.collect()] == [2, 1, 0]


def test_partial_spearman_shuffles_rows_once(spark, capsys):
    """each of three ranks was joined to shuffled rows. Ties, a NULL group and rows with a NULL."""
    rng = np.random.default_rng(5)
    data = [("ab"[i % 2] if i % 7 else None, float(rng.integers(0, 9)), float(rng.integers(0, 90)) if i % 13 else None, float(rng.integers(0, 5))) for i in range(900)]
    rows = spark.createDataFrame(data, "g string, x double, y double, z double")
    out = T.partial_spearman(rows, "x", "y", "z", ["g"])
    got = {r.g: (r.rho, r.n) for r in out.collect()}
    for g in ("a", "b", None):
        own = np.array([d[1:] for d in data if d[0] == g and d[2] is not None])
        ranks = np.array([[(c < v).sum() + ((c == v).sum() + 1) / 2 for v in c] for c in own.T])
        (_, xy, xz), (_, _, yz), _ = np.corrcoef(ranks)
        assert got[g] == (pytest.approx((xy - xz * yz) / math.sqrt((1 - xz**2) * (1 - yz**2))), len(own))
    out.explain()
    assert "SortMergeJoin" not in capsys.readouterr().out

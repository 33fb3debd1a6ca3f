"""Queries over vectors: answer scores, geometry, heads and layers.

``embeddings`` stands in for stored tensors: the first four places are the scores
of A to D with gold ``label % 4``; place p is layer p div 8, head p mod 8; an
even vec_id is an original and the next its edited copy.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.functions import vectors as V
from pairloom.operators import aggregates as G
from pairloom.operators import joins as J
from pairloom.operators import rules, windows
from pairloom.operators.sets import exclusive_memberships
from pairloom.plans import probes
from pairloom.plans.registry import query
from pairloom.session import table

# ---------------------------------------------------------------- shared shapes


def vecs(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.as_double(F.col("embedding")).alias("v"))


def scores(spark, sf_dir):
    return vecs(spark, sf_dir).select("vec_id", "label", (F.col("label") % 4).cast("int").alias("gold"), F.slice("v", 1, 4).alias("z"))


def score_pairs(spark, sf_dir):
    """(pair, label, gold, zo, ze): originals with their edited copies, by an equi-join on the pair."""
    s = scores(spark, sf_dir).withColumn("pair", F.floor(F.col("vec_id") / 2).cast("bigint"))
    orig = s.where("vec_id % 2 = 0").select("pair", "label", "gold", F.col("z").alias("zo"))
    edited = s.where("vec_id % 2 = 1").select("pair", F.col("z").alias("ze"))
    return orig.join(edited, "pair")


def long_heads(spark, sf_dir):
    """(vec_id, label, layer, head, x)"""
    long = vecs(spark, sf_dir).select("vec_id", "label", F.posexplode("v").alias("p", "x"))
    return long.select("vec_id", "label", F.floor(F.col("p") / 8).cast("int").alias("layer"), (F.col("p") % 8).cast("int").alias("head"), "x")


SV = "v as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings)"
SZ = SV + ", s as (select vec_id, label, cast(label % 4 as integer) as gold, v[1:4] as z from v)"
SP = SZ + ", p as (select o.vec_id // 2 as pair, o.label, o.gold, o.z as zo, e.z as ze from s o join s e on e.vec_id = o.vec_id + 1 where o.vec_id % 2 = 0)"
SH = SV + ", h as (select vec_id, label, cast((p - 1) // 8 as integer) as layer, cast((p - 1) % 8 as integer) as head, x from (select vec_id, label, unnest(v) as x, generate_subscripts(v, 1) as p from v))"


def _prob(z: str) -> str:
    return f"exp({z}[gold + 1] - list_max({z})) / list_sum(list_transform({z}, lambda x: exp(x - list_max({z}))))"


def _pred(z: str) -> str:
    return f"cast(list_position({z}, list_max({z})) - 1 as integer)"


def _margin(z: str) -> str:
    return f"{z}[gold + 1] - list_max(list_filter({z}, lambda x, i: i <> gold + 1))"


def _norm(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: x * x)))"


# ---------------------------------------------------------------- scores


@query("VEC1 VEC2 VEC3", f"with {SZ} select vec_id, round({_prob('z')}, 6) as gold_prob, {_pred('z')} as pred, substr('ABCD', {_pred('z')} + 1, 1) as letter, round({_margin('z')}, 6) as margin from s")
def softmax_margin(spark, sf_dir):
    z, gold = F.col("z"), F.col("gold")
    return scores(spark, sf_dir).select("vec_id", F.round(V.gold_probability(z, gold), 6).alias("gold_prob"), V.prediction(z).alias("pred"), V.letter(V.prediction(z)).alias("letter"), F.round(V.margin(z, gold), 6).alias("margin"))


BEHAVIOR = f"""b as (select pair, label, gold, {_pred('zo')} as po, {_pred('ze')} as pe, zo[gold + 1] as lo, ze[gold + 1] as le, {_margin('zo')} as mo, {_margin('ze')} as me from p)"""


def behavior(spark, sf_dir):
    p, gold = score_pairs(spark, sf_dir), F.col("gold")
    return p.select(
        "pair", "label", "gold", V.prediction(F.col("zo")).alias("po"), V.prediction(F.col("ze")).alias("pe"),
        F.get("zo", gold).alias("lo"), F.get("ze", gold).alias("le"), V.margin(F.col("zo"), gold).alias("mo"), V.margin(F.col("ze"), gold).alias("me"),
    )


@query("VEC4 JN1", f"with {SP}, {BEHAVIOR} select pair, po <> pe as answer_flip, (po = gold) <> (pe = gold) as correctness_flip, round(le - lo, 6) as delta_logit, round(abs(me - mo), 6) as abs_delta_margin from b")
def pairwise_flip(spark, sf_dir):
    b = behavior(spark, sf_dir)
    return b.select("pair", (F.col("po") != F.col("pe")).alias("answer_flip"), ((F.col("po") == F.col("gold")) != (F.col("pe") == F.col("gold"))).alias("correctness_flip"), F.round(F.col("le") - F.col("lo"), 6).alias("delta_logit"), F.round(F.abs(F.col("me") - F.col("mo")), 6).alias("abs_delta_margin"))


@query(
    "AGG21",
    f"""with {SP}, {BEHAVIOR}, f as (select label, po <> pe as fl, po = gold as o, pe = gold as e from b)
select label, count(*) as n, count_if(fl) as n_flips, count_if(fl and o and not e) as correct_to_wrong, count_if(fl and not o and e) as wrong_to_correct,
  count_if(fl and o and e) as correct_to_correct_diff, count_if(fl and not o and not e) as wrong_to_wrong_diff, count_if(not fl) as no_flip,
  count_if(not fl and o) as no_flip_correct, count_if(not fl and not o) as no_flip_wrong, round(count_if(fl) / count(*), 6) as flip_rate,
  round(count_if(fl and o and not e) / count(*), 6) as harm_rate, round(count_if(fl and not o and e) / count(*), 6) as benefit_rate,
  round((count_if(fl and o and not e) - count_if(fl and not o and e)) / count(*), 6) as net_harm
from f group by label""",
)
def flip_harm(spark, sf_dir):
    b = behavior(spark, sf_dir)
    cols = G.flip_table(F.col("po") != F.col("pe"), F.col("po") == F.col("gold"), F.col("pe") == F.col("gold"))
    out = b.groupBy("label").agg(*cols)
    return out.withColumns({c: F.round(c, 6) for c in ("flip_rate", "harm_rate", "benefit_rate", "net_harm")})


@query("AGG22 AGG7", f"with {SP}, {BEHAVIOR} select po as pred, count_if(pe = 0) as to_0, count_if(pe = 1) as to_1, count_if(pe = 2) as to_2, count_if(pe = 3) as to_3 from b group by po")
def transition_matrix(spark, sf_dir):
    m = G.crosstab(behavior(spark, sf_dir), "po", "pe", [0, 1, 2, 3])
    return m.select(F.col("po").alias("pred"), *[F.col(str(k)).alias(f"to_{k}") for k in range(4)])


RECOVERY = """r as (select o.vec_id // 3 as item, o.label, o.z[1] as a, e.z[1] - o.z[1] as d, q.z[1] - o.z[1] as r,
    list_position(o.z, list_max(o.z)) - 1 = o.gold as orig_correct, list_position(o.z, list_max(o.z)) <> list_position(e.z, list_max(e.z)) as flip
  from s o join s e on e.vec_id = o.vec_id + 1 join s q on q.vec_id = o.vec_id + 2 where o.vec_id % 3 = 0),
m as (select *, case when abs(d) >= 0.05 then greatest(-3.0, least(3.0, 1 - r / (d + 1e-8))) end as recovery,
    case when abs(d) >= 0.05 then (abs(d) - abs(r)) / (abs(d) + 1e-8) end as fraction,
    case when abs(d) >= 0.05 then greatest(-3.0, least(3.0, r / (d + 1e-8))) end as injection,
    case when d > 1e-6 then 'positive' when d < -1e-6 then 'negative' else 'zero' end as sd,
    case when r > 1e-6 then 'positive' when r < -1e-6 then 'negative' else 'zero' end as sr from r)"""


def triples(spark, sf_dir):
    """(item, label, d, r, orig_correct, flip): three rows in turn are original, edited and patched."""
    s = scores(spark, sf_dir).withColumn("item", F.floor(F.col("vec_id") / 3).cast("bigint"))
    part = [s.where(f"vec_id % 3 = {k}").select("item", F.col("z").alias(f"z{k}"), *(["label", "gold"] if k == 0 else [])) for k in range(3)]
    t = part[0].join(part[1], "item").join(part[2], "item")
    first = [F.get(f"z{k}", F.lit(0)) for k in range(3)]
    return t.select("item", "label", (first[1] - first[0]).alias("d"), (first[2] - first[0]).alias("r"), (V.prediction(F.col("z0")) == F.col("gold")).alias("orig_correct"), (V.prediction(F.col("z0")) != V.prediction(F.col("z1"))).alias("flip"))


@query(
    "VEC16 VEC17 VEC18 VEC19 VEC20 FLT7",
    f"""with {SZ}, {RECOVERY} select item, round(recovery, 6) as recovery, round(fraction, 6) as causal_fraction, round(injection, 6) as injection, sd as sign_before, sr as sign_after,
  coalesce(recovery > 1, false) as overshoot, coalesce(abs(recovery) < 0.05, false) as no_effect, sd = sr as same_direction,
  (sd <> sr and sd <> 'zero') and sr <> 'zero' as reversal, not (sd <> sr and sd <> 'zero') and abs(r) < abs(d) as attenuation,
  not (sd <> sr and sd <> 'zero') and abs(r) > abs(d) as amplification from m""",
)
def recovery_flags(spark, sf_dir):
    d, r = F.col("d"), F.col("r")
    return triples(spark, sf_dir).select(
        "item", F.round(V.recovery(d, r), 6).alias("recovery"), F.round(V.causal_fraction(F.abs(d), F.abs(r)), 6).alias("causal_fraction"), F.round(V.injection(r, d), 6).alias("injection"),
        V.sign_of(d).alias("sign_before"), V.sign_of(r).alias("sign_after"), *[c.alias(n) for n, c in V.movement_flags(d, r).items()],
    )


STATS_SQL = "count(*) as n, count(x) as n_valid, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.75), 6) as p75, round(avg(case when x > 0 then 1 when x <= 0 then 0 end), 6) as frac_positive, round(avg(case when x < 0 then 1 when x >= 0 then 0 end), 6) as frac_negative"


@query(
    "AGG14 AGG15 AGG16 AGG17 AGG18 AGG19",
    f"""with {SZ}, {RECOVERY}, st as (
  select 'all' as stratum, * from m union all select 'orig_correct', * from m where orig_correct union all select 'significant', * from m where abs(d) >= 0.05
  union all select 'correct_sig', * from m where orig_correct and abs(d) >= 0.05 union all select 'answer_flip', * from m where flip),
l as (select stratum, 'recovery' as metric, cast(recovery as double) as x from st union all select stratum, 'injection', cast(injection as double) from st
  union all select stratum, 'flip_rate', cast(cast(flip as integer) as double) from st)
select stratum, metric, {STATS_SQL} from l group by 1, 2""",
)
def strata_stats(spark, sf_dir):
    d, r = F.col("d"), F.col("r")
    strong = F.abs(d) >= 0.05
    strata = {"all": F.lit(True), "orig_correct": F.col("orig_correct"), "significant": strong, "correct_sig": F.col("orig_correct") & strong, "answer_flip": F.col("flip")}
    out = G.by_strata(triples(spark, sf_dir), strata, {"recovery": V.recovery(d, r), "injection": V.injection(r, d)}, {"flip": F.col("flip")})
    return out.withColumns({c: F.round(c, 6) for c in G.STATS[2:]})


@query(
    "VEC22 VEC21",
    "select label, round((acc - 1.0 / k) / (1 - 1.0 / k), 6) as gain, round(acc + acc * acc - 0.5 * acc, 6) as score from (select label, avg(cast(embedding[1] > 0 as integer)) as acc, cast(greatest(label, 2) as double) as k from embeddings group by label)",
)
def gain_over_chance(spark, sf_dir):
    acc = vecs(spark, sf_dir).groupBy("label").agg(F.avg((F.get("v", F.lit(0)) > 0).cast("int")).alias("acc"))
    k = F.greatest(F.col("label"), F.lit(2)).cast("double")
    return acc.select("label", F.round(V.normalized_gain(F.col("acc"), k), 6).alias("gain"), F.round(V.layer_score(F.col("acc"), F.col("acc") * F.col("acc"), F.col("acc")), 6).alias("score"))


# ---------------------------------------------------------------- geometry


SD = SV + ", p as (select o.vec_id // 2 as pair, o.label, o.v as a, e.v as b from v o join v e on e.vec_id = o.vec_id + 1 where o.vec_id % 2 = 0)"


def vector_pairs(spark, sf_dir):
    s = vecs(spark, sf_dir).withColumn("pair", F.floor(F.col("vec_id") / 2).cast("bigint"))
    return s.where("vec_id % 2 = 0").select("pair", "label", F.col("v").alias("a")).join(s.where("vec_id % 2 = 1").select("pair", F.col("v").alias("b")), "pair")


@query(
    "VEC5 VEC6 VEC13",
    f"""with {SD}, n as (select pair, {_norm('a')} as na, {_norm('b')} as nb, list_distance(a, b) as e, list_dot_product(a, b) as d from p)
select pair, round(e, 6) as euclidean, round(e / ((na + nb) / 2), 6) as norm_euclidean, round(1 - greatest(-1.0, least(1.0, d / (na * nb))), 6) as cosine_dist, round(na, 6) as orig_norm,
  round(d / (na * nb), 6) as cosine, round(d / (na * nb + 1e-8), 6) as cosine_padded from n""",
)
def pair_distances(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    cols = V.pair_distances(a, b) | {"cosine": V.cosine(a, b), "cosine_padded": V.cosine_padded(a, b)}
    return vector_pairs(spark, sf_dir).select("pair", *[F.round(c, 6).alias(n) for n, c in cols.items()])


@query("VEC8 FLT8 VEC12 WIN12 AGG36", f"with {SV} select vec_id, round({_norm('v')}, 6) as norm, round(v[1] / {_norm('v')}, 6) as first_unit, round(list_sum(v[9:16]) / 8, 6) as layer1_mean, round(list_max(v) - list_min(v), 6) as spread, round(v[1] / list_max(v), 6) as first_of_max, true as finite from v")
def unit_vectors(spark, sf_dir):
    v = F.col("v")
    return vecs(spark, sf_dir).select(
        "vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(F.get(V.unit(v), F.lit(0)), 6).alias("first_unit"), F.round(V.total(F.slice(v, 9, 8)) / 8, 6).alias("layer1_mean"),
        F.round(F.array_max(v) - F.array_min(v), 6).alias("spread"), F.round(F.get(V.row_normalised(v), F.lit(0)), 6).alias("first_of_max"), V.finite(v).alias("finite"),
    )


@query(
    "VEC10 VEC29 VEC9",
    f"""with {SV}, d as (select vec_id, v[1:8] as v, v[9:16] as d1, v[17:24] as d2 from v),
g as (select vec_id, list_dot_product(d1, d1) as a, list_dot_product(d1, d2) as b, list_dot_product(d2, d2) as c, list_dot_product(v, d1) as p, list_dot_product(v, d2) as q, list_dot_product(v, v) as w from d),
k as (select *, (p * c - q * b) / (a * c - b * b) as b1, (q * a - p * b) / (a * c - b * b) as b2 from g)
select vec_id, round(b1, 6) as beta1, round(b2, 6) as beta2, round(sqrt(greatest(w - b1 * p - b2 * q, 0)), 5) as residual_norm, round(1 - greatest(w - b1 * p - b2 * q, 0) / w, 6) as explained,
  round(p / sqrt(a), 6) as projection, round(p + 0.5 * sqrt(a) * sqrt(a) * sqrt(a), 5) as moved_dot from k""",
)
def joint_decompose(spark, sf_dir):
    rows = vecs(spark, sf_dir).select("vec_id", F.slice("v", 1, 8).alias("v"), F.slice("v", 9, 8).alias("d1"), F.slice("v", 17, 8).alias("d2"))
    v, d1, d2 = F.col("v"), F.col("d1"), F.col("d2")
    parts = V.decompose(v, d1, d2)
    pushed = V.dot(V.add_direction(v, V.scale(d1, V.norm(d1)), 0.5), d1)
    return rows.select(
        "vec_id", F.round(parts["beta1"], 6).alias("beta1"), F.round(parts["beta2"], 6).alias("beta2"), F.round(parts["residual_norm"], 5).alias("residual_norm"),
        F.round(parts["explained"], 6).alias("explained"), F.round(V.dot(v, V.unit(d1)), 6).alias("projection"), F.round(pushed, 5).alias("moved_dot"),
    )


@query("VEC29", f"with {SV} select vec_id, cast(0.0 as double) as left_along from v")
def direction_removed(spark, sf_dir):
    rows = vecs(spark, sf_dir).select("vec_id", F.slice("v", 1, 8).alias("v"), V.unit(F.slice("v", 9, 8)).alias("d"))
    return rows.select("vec_id", F.abs(F.round(V.dot(V.remove_direction(F.col("v"), F.col("d")), F.col("d")), 6)).alias("left_along"))


@query(
    "VEC11 FLT13 ARR5",
    f"""with {SV}, w as (select vec_id, label, list_transform(v[1:16], lambda x: x * x / list_sum(list_transform(v[1:16], lambda y: y * y))) as w from v)
select vec_id, round(-list_sum(list_transform(w, lambda x: x * ln(x + 1e-12))), 6) as entropy, round(w[1] + w[label + 1], 6) as mass, cast(case when label = 0 then 1 else 2 end as bigint) as n_valid from w""",
)
def attention_masses(spark, sf_dir):
    v = F.slice("v", 1, 16)
    rows = vecs(spark, sf_dir).select("vec_id", "label", F.transform(v, lambda x: x * x / V.total(F.transform(v, lambda y: y * y))).alias("w"))
    positions = F.array(F.lit(0), F.col("label"), F.lit(-1), F.lit(16))
    inside = A.shifted(positions, F.lit(0), F.size("w"))
    mass = V.mass_at(F.col("w"), positions)
    return rows.select("vec_id", F.round(V.entropy(F.col("w")), 6).alias("entropy"), F.round(mass, 6).alias("mass"), F.size(F.array_distinct(inside)).cast("bigint").alias("n_valid"))


@query("AGG24 VEC25", f"with {SH}, c as (select label, layer * 8 + head as pos, avg(x) as m from h group by 1, 2) select label, round(sqrt(sum(m * m)), 6) as centroid_norm, round(sum(m), 6) as centroid_sum, cast(count(*) as bigint) as dim from c group by label")
def centroids(spark, sf_dir):
    c = G.centroid(vecs(spark, sf_dir), ["label"], "v")
    return c.select("label", F.round(V.norm(F.col("centroid")), 6).alias("centroid_norm"), F.round(V.total(F.col("centroid")), 6).alias("centroid_sum"), F.size("centroid").cast("bigint").alias("dim"))


CENTROID = "c as (select label, list(m order by pos) as c from (select label, layer * 8 + head as pos, avg(x) as m from h group by 1, 2) group by label)"


@query("ST20 JN14", f"with {SH}, {CENTROID} select a.label as a, b.label as b, round(list_cosine_similarity(a.c, b.c), 6) as cosine from c a join c b on a.label < b.label")
def centroid_alignment(spark, sf_dir):
    return probes.centroid_alignment(vecs(spark, sf_dir), "label", "v").withColumn("cosine", F.round("cosine", 6))


@query(
    "VEC25 AGG13",
    f"with {SH}, {CENTROID} select v.label, round(avg(list_cosine_similarity(v, c)), 6) as mean, round(stddev_pop(list_cosine_similarity(v, c)) / sqrt(count(*)), 6) as sem, count(*) as n from v join c on v.label = c.label group by v.label",
)
def cosine_to_centroid(spark, sf_dir):
    rows = vecs(spark, sf_dir)
    joined = rows.join(G.centroid(rows, ["label"], "v").select("label", "centroid"), "label").withColumn("cos", V.cosine(F.col("v"), F.col("centroid")))
    return G.curve(joined, ["label"], F.col("cos")).withColumns({"mean": F.round("mean", 6), "sem": F.round("sem", 6)})


@query("VEC7", f"with {SV} select a.label, round(avg(list_cosine_similarity(a.v, b.v)), 6) as coherence from v a join v b on a.label = b.label and a.vec_id < b.vec_id group by a.label")
def coherence_by_label(spark, sf_dir):
    return probes.coherence(vecs(spark, sf_dir), ["label"], "v").select("label", F.round("coherence", 6).alias("coherence"))


DIRECTION = "c as (select layer * 8 + head as pos, avg(x) filter (where label < 5) - avg(x) filter (where label >= 5) as m from h group by 1), u as (select list(m / n order by pos) as d, any_value(n) as n from c, (select sqrt(sum(m * m)) as n from c))"


@query("ST12", f"with {SH}, {DIRECTION}, t as (select label < 5 as y, list_dot_product(v, d) as s from v, u) select round(avg(cast(y = (s > (select avg(s) from t)) as integer)), 6) as accuracy, count(*) as n from t")
def dim_threshold(spark, sf_dir):
    return probes.threshold_probe(vecs(spark, sf_dir), "v", F.col("label") < 5).withColumn("accuracy", F.round("accuracy", 6))


@query("VEC9 ST24", f"with {SH}, {DIRECTION} select label, round(avg(list_dot_product(v, d)), 6) as mean, round(stddev_pop(list_dot_product(v, d)), 6) as std, round(any_value(n), 6) as norm from v, u group by label")
def projection_stats(spark, sf_dir):
    rows = vecs(spark, sf_dir).withColumn("k", F.lit(1))
    d = probes.direction(rows, ["k"], "v", F.col("label") < 5)
    p = probes.projections(rows, ["k"], "v", d).join(d.select("k", "norm"), "k")
    return p.groupBy("label").agg(F.round(F.avg("projection"), 6).alias("mean"), F.round(F.stddev_pop("projection"), 6).alias("std"), F.round(F.first("norm"), 6).alias("norm"))


@query(
    "ST17 JN13 VEC7",
    f"""with {SV}, r as (select *, row_number() over (partition by label order by md5(cast(vec_id as varchar) || ':0'), vec_id) as r from v),
p as (select a.label, 1 - list_cosine_similarity(a.v, b.v) as x, 1 - list_cosine_similarity(a.v[1:8], b.v[1:8]) as y from r a join r b on a.label = b.label and a.r < b.r where a.r <= 50 and b.r <= 50),
k as (select label, rank() over (partition by label order by x) + (count(*) over (partition by label, x) - 1) / 2.0 as rx, rank() over (partition by label order by y) + (count(*) over (partition by label, y) - 1) / 2.0 as ry from p)
select label, round(corr(rx, ry), 6) as rho, count(*) as n from k group by label""",
)
def rsa_by_label(spark, sf_dir):
    from pairloom.plans.statistics import spearman

    pairs = J.pairs_within(vecs(spark, sf_dir), "label", "vec_id", "v", 50)
    d = pairs.select("label", (1.0 - V.cosine(F.col("va"), F.col("vb"))).alias("x"), (1.0 - V.cosine(F.slice("va", 1, 8), F.slice("vb", 1, 8))).alias("y"))
    return spearman(d, "x", "y", ["label"]).withColumn("rho", F.round("rho", 6))


@query("VEC23 VEC30", f"with {SV}, t as (select o.vec_id // 4 as item, list_distance(d.v, o.v) as ab, list_distance(a.v, o.v) as a, list_distance(b.v, o.v) as b from v o join v a on a.vec_id = o.vec_id + 1 join v b on b.vec_id = o.vec_id + 2 join v d on d.vec_id = o.vec_id + 3 where o.vec_id % 4 = 0) select item, round(ab / (a + b), 6) as ratio from t")
def additivity_ratio(spark, sf_dir):
    s = vecs(spark, sf_dir).select(F.floor(F.col("vec_id") / 4).cast("bigint").alias("item"), (F.col("vec_id") % 4).alias("condition"), "v")
    orig = s.where("condition = 0").select("item", F.col("v").alias("o"))
    shift = s.where("condition > 0").join(orig, "item").withColumn("shift", V.difference(F.col("v"), F.col("o"))).where(F.exists("shift", lambda x: x != 0))
    d = shift.groupBy("item").agg(*[F.max(F.when(F.col("condition") == k, V.norm(F.col("shift")))).alias(n) for k, n in ((1, "a"), (2, "b"), (3, "ab"))])
    return d.where("a is not null and b is not null and ab is not null").select("item", F.round(V.additivity(F.col("ab"), F.col("a"), F.col("b")), 6).alias("ratio"))


# ---------------------------------------------------------------- heads and layers


@query("AGG20 D20", f"with {SH} select label, layer, head, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(avg(cast(x > 0 as integer)), 6) as frac_positive, count(x) as n from h group by 1, 2, 3")
def head_scores(spark, sf_dir):
    return G.cell_moments(long_heads(spark, sf_dir), ["label", "layer", "head"], F.col("x")).withColumns({c: F.round(c, 6) for c in ("mean", "std", "frac_positive")})


TOP = f"{SH}, m as (select label, layer, head, avg(x) as s from h group by 1, 2, 3), k as (select *, row_number() over (partition by label order by s desc, layer desc, head desc) as rank from m)"


@query("WIN4 WIN5 PRJ28 T14", f"with {TOP} select label, 'L' || lpad(cast(layer as varchar), 2, '0') || 'H' || lpad(cast(head as varchar), 2, '0') as head_key, rank, round(s, 6) as score from k where rank <= 10")
def rank_heads(spark, sf_dir):
    m = long_heads(spark, sf_dir).groupBy("label", "layer", "head").agg(F.avg("x").alias("s"))
    top = windows.rank_heads(m, "s", 10, ["label"])
    return top.select("label", rules.head_key(F.col("layer"), F.col("head")).alias("head_key"), F.col("rank").cast("bigint").alias("rank"), F.round("s", 6).alias("score"))


@query(
    "WIN1 WIN2 WIN3 SRT1",
    f"""with {SH}, g as (select label, head, count(*) as n, avg(abs(x)) as e, avg(x * x) as t, avg(abs(x) * layer) as b from h group by 1, 2),
z as (select *, (e - avg(e) over w) / stddev_pop(e) over w as ze, (t - avg(t) over w) / stddev_pop(t) over w as zt, (b - avg(b) over w) / stddev_pop(b) over w as zb from g window w as (partition by label)),
r as (select *, ze + 0.5 * zt + 0.75 * zb as s, row_number() over (partition by label order by ze + 0.5 * zt + 0.75 * zb desc, head) as rank from z)
select label, head, n, round(ze, 6) as z_edit, round(s, 6) as candidate_score, rank from r where rank <= 3""",
)
def zscore_candidates(spark, sf_dir):
    h = long_heads(spark, sf_dir).select("label", "head", F.abs("x").alias("edit"), (F.col("x") * F.col("x")).alias("entropy"), (F.abs("x") * F.col("layer")).alias("behavior"))
    c = windows.candidate_heads(h, "label", "head", "edit", "entropy", "behavior")
    top = windows.top_k(c, ["label"], [F.col("candidate_score").desc(), F.col("head")], 3)
    return top.select("label", "head", "n", F.round("z_edit", 6).alias("z_edit"), F.round("candidate_score", 6).alias("candidate_score"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "SET5 SET6 JN14",
    f"""with {TOP}, t as (select label, list(layer * 8 + head) as hs from k where rank <= 10 group by label)
select a.label as a, b.label as b, cast(len(list_intersect(a.hs, b.hs)) as bigint) as n_common, cast(len(list_distinct(list_concat(a.hs, b.hs))) as bigint) as n_union,
  round(len(list_intersect(a.hs, b.hs)) / len(list_distinct(list_concat(a.hs, b.hs))), 6) as jaccard from t a join t b on a.label < b.label""",
)
def head_overlap(spark, sf_dir):
    m = long_heads(spark, sf_dir).groupBy("label", "layer", "head").agg(F.avg("x").alias("s"))
    sets = windows.rank_heads(m, "s", 10, ["label"]).groupBy("label").agg(F.collect_list(F.col("layer") * 8 + F.col("head")).alias("hs"))
    pairs = J.label_matrix(sets, "label", "hs").where("a < b")
    return pairs.select("a", "b", F.size(F.array_intersect("va", "vb")).cast("bigint").alias("n_common"), F.size(F.array_union("va", "vb")).cast("bigint").alias("n_union"), F.round(V.jaccard(F.col("va"), F.col("vb")), 6).alias("jaccard"))


@query("SET7", f"with {TOP}, b as (select layer, head, sum(cast(pow(2, label) as bigint)) as bitmap from k where rank <= 10 group by 1, 2) select cast(bitmap as bigint) as bitmap, count(*) as n from b group by 1")
def head_memberships(spark, sf_dir):
    m = long_heads(spark, sf_dir).groupBy("label", "layer", "head").agg(F.avg("x").alias("s"))
    return exclusive_memberships(windows.rank_heads(m, "s", 10, ["label"]), ["layer", "head"], "label", list(range(10)))


@query("AGG27", f"with {SH}, g as (select layer, head, label, avg(abs(x)) as m from h group by 1, 2, 3) select layer, head, round(stddev_pop(m) / (avg(m) + 1e-10), 6) as cv, count(*) as n_groups from g group by 1, 2")
def selectivity(spark, sf_dir):
    return G.variation(long_heads(spark, sf_dir), ["layer", "head"], "label", F.abs("x")).withColumn("cv", F.round("cv", 6))


def _top(v: str) -> str:
    return f"list_transform(list_sort(list_transform({v}, lambda x, i: {{'w': -x, 'i': i - 1}}))[1:5], lambda s: s.i)"


@query("SET8 SRT3 T10", f"with {SD}, t as (select pair, {_top('a')} as ta, {_top('b')} as tb from p) select pair, round(len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))), 6) as jaccard, cast(ta[1] as integer) as first_a from t")
def topk_jaccard(spark, sf_dir):
    ta, tb = A.padded_top_k(F.col("a"), 5), A.padded_top_k(F.col("b"), 5)
    rows = vector_pairs(spark, sf_dir).select("pair", ta.alias("ta"), tb.alias("tb"))
    return rows.select("pair", F.round(V.jaccard(V.valid_positions(F.col("ta")), V.valid_positions(F.col("tb"))), 6).alias("jaccard"), F.get("ta", F.lit(0)).cast("int").alias("first_a"))


@query(
    "VEC14 VEC15 AGG25",
    f"""with {SH} select vec_id, round(avg(x) filter (where layer >= 4), 6) as late_mean, round(avg(abs(x)) filter (where layer >= 4), 6) as late_abs_mean, round(max(abs(x)) filter (where layer >= 4), 6) as late_abs_max,
  round(avg(x) filter (where layer < 2), 6) as q1_mean from h group by vec_id""",
)
def late_head_table(spark, sf_dir):
    late, q1 = F.col("layer") >= 4, rules.quarter_region(F.col("layer"), 8) == "q1"
    x = F.col("x")
    return long_heads(spark, sf_dir).groupBy("vec_id").agg(
        F.round(F.avg(F.when(late, x)), 6).alias("late_mean"), F.round(F.avg(F.when(late, F.abs(x))), 6).alias("late_abs_mean"), F.round(F.max(F.when(late, F.abs(x))), 6).alias("late_abs_max"), F.round(F.avg(F.when(q1, x)), 6).alias("q1_mean")
    )


@query("AGG13 PRJ26", f"with {SH} select label, layer, case when layer = 0 then 'embedding' when layer < 4 then 'early' when layer < 16 then 'mid' else 'late' end as region, case when layer + 1 < 4 then 'early' else 'mid' end as block_region, round(avg(x), 6) as mean, round(stddev_pop(x) / sqrt(count(x)), 6) as sem, count(x) as n from h group by 1, 2")
def layer_curve_sem(spark, sf_dir):
    c = G.curve(long_heads(spark, sf_dir), ["label", "layer"], F.col("x"))
    return c.select("label", "layer", rules.layer_region(F.col("layer")).alias("region"), rules.block_region(F.col("layer")).alias("block_region"), F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"), "n")


@query("AGG26 WIN7 AGG30", f"with {SH}, c as (select label, layer, avg(abs(x)) as m from h group by 1, 2), r as (select *, row_number() over (partition by label order by m desc, layer) as r from c) select label, max(layer) filter (where r = 1) as peak, round(max(m), 6) as peak_value, round(avg(m), 6) as mean from r group by label")
def peak_layer(spark, sf_dir):
    c = long_heads(spark, sf_dir).groupBy("label", "layer").agg(F.avg(F.abs("x")).alias("m"))
    return G.peak(c, ["label"], "layer", "m").withColumns({"peak_value": F.round("peak_value", 6), "mean": F.round("mean", 6)})


@query("AGG30", f"with {SH}, c as (select label, layer, avg(abs(x)) as m from h group by 1, 2) select label, round(100 * avg(m) filter (where layer < 2) / avg(m), 6) as early_share_pct from c group by label")
def early_share(spark, sf_dir):
    c = long_heads(spark, sf_dir).groupBy("label", "layer").agg(F.avg(F.abs("x")).alias("m"))
    return G.share_of_full(c, ["label"], F.col("layer") < 2, F.lit(True), "m").withColumn("early_share_pct", F.round("early_share_pct", 6))


@query(
    "VEC24 VEC26",
    f"""with {SH}, c as (select label, layer, avg(abs(x)) as m from h group by 1, 2), f as (select label, regr_slope(ln(m), cast(layer as double)) as a, regr_intercept(ln(m), cast(layer as double)) as b from c where layer >= 2 group by label)
select c.label, c.layer, round(a, 6) as slope, round(m - exp(b + a * c.layer), 6) as residual from c join f on c.label = f.label""",
)
def decay_residual(spark, sf_dir):
    c = long_heads(spark, sf_dir).groupBy("label", "layer").agg(F.avg(F.abs("x")).alias("m")).withColumn("l", F.col("layer").cast("double"))
    fit = c.where("layer >= 2").groupBy("label").agg(F.regr_slope(F.log("m"), F.col("l")).alias("a"), F.regr_intercept(F.log("m"), F.col("l")).alias("b"))
    return c.join(fit, "label").select("label", "layer", F.round("a", 6).alias("slope"), F.round(F.col("m") - F.exp(F.col("b") + F.col("a") * F.col("l")), 6).alias("residual"))


@query("AGG23 AGG31 PRJ36", f"with {SH} select case when head in (0, 1) then 'edit' when head = 2 then 'largest_edit' when head >= 6 then 'answer_region' else 'question' end as region, round(sum(abs(x)) / 8, 6) as mass, count(*) as n from h group by 1")
def region_masses(spark, sf_dir):
    region = A.position_region(F.col("head"), F.array(F.lit(0), F.lit(1)), F.array(F.lit(1), F.lit(2)), F.lit(8))
    return long_heads(spark, sf_dir).groupBy(region.alias("region")).agg(F.round(F.sum(F.abs("x")) / 8, 6).alias("mass"), F.count("*").alias("n"))


@query("AGG23", f"with {SH}, m as (select layer, head, avg(x) as m from h group by 1, 2) select 'layer' as axis, layer as at, round(avg(m), 6) as mean from m group by layer union all select 'head', head, round(avg(m), 6) from m group by head")
def map_marginals(spark, sf_dir):
    m = long_heads(spark, sf_dir).groupBy("layer", "head").agg(F.avg("x").alias("m"))
    sides = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("at")) for a in ("layer", "head")]))
    return m.select(sides.alias("s"), "m").groupBy("s.axis", "s.at").agg(F.round(F.avg("m"), 6).alias("mean"))


@query(
    "ARR7 T19",
    """with t as (select s_suppkey, cast(s_suppkey % 5 as integer) as k from supplier), a as (select s_suppkey, k, [1, 2, 3, 4, 5, 6] as a, case when k = 0 then [1, 2, 3, 4, 5, 6] when k = 1 then [1, 2, 9, 4, 5, 6] when k = 2 then [1, 2, 8, 9, 5, 6] when k = 3 then [1, 2, 5, 6] else [9, 2, 3, 4, 5, 6] end as b from t)
select s_suppkey, case k when 0 then 6 when 1 then 2 when 2 then 2 when 3 then 2 else 0 end as start, case k when 0 then 6 when 1 then 3 when 2 then 4 when 3 then 4 else 1 end as end_a, k in (1, 2, 4) as valid, case when k in (1, 2, 4) then false else true end as whole from a""",
)
def edited_spans(spark, sf_dir):
    k = F.col("s_suppkey") % 5

    def ints(*xs):
        return F.array(*[F.lit(x) for x in xs])

    b = F.when(k == 0, ints(1, 2, 3, 4, 5, 6)).when(k == 1, ints(1, 2, 9, 4, 5, 6)).when(k == 2, ints(1, 2, 8, 9, 5, 6)).when(k == 3, ints(1, 2, 5, 6)).otherwise(ints(9, 2, 3, 4, 5, 6))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", ints(1, 2, 3, 4, 5, 6).alias("a"), b.alias("b"))
    span, full = A.edited_span(F.col("a"), F.col("b")), A.edited_span(F.col("a"), F.col("b"), fallback=True)
    return rows.select("s_suppkey", span["start"].alias("start"), span["end_a"].alias("end_a"), span["valid"].alias("valid"), (~full["valid"] & (full["start"] == 0) & (full["end_a"] == 6)).alias("whole"))


@query("ST10 WIN13")
def pca_variance(spark, sf_dir):
    _, explained = probes.principal_components(vecs(spark, sf_dir), "v", 8, "vec_id")
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(explained)], "component int, explained double")
    return windows.cumulative(rows, [], "component", "explained")


@query("ST26")
def standardised_pca(spark, sf_dir):
    z = probes.standardised(vecs(spark, sf_dir), "v", "vec_id")
    pc, _ = probes.principal_components(z, "z", 2, "vec_id")
    return pc.select("vec_id", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))


@query("ST13 ST14 ST15 SMP8 ST25")
def layer_probe_metrics(spark, sf_dir):
    rows = vecs(spark, sf_dir).select("vec_id", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))).alias("layer", "h"))
    return probes.layer_probes(rows, "layer", "h", "label", "vec_id")


@query("ST11 ST16 SMP9")
def loo_probes(spark, sf_dir):
    rows = vecs(spark, sf_dir).select((F.col("vec_id") % 10).alias("fold"), (F.col("label") < 5).alias("y"), "v")
    return probes.leave_one_out(rows, "fold", "v", "y")


@query("ST18")
def head_clusters(spark, sf_dir):
    m = long_heads(spark, sf_dir).groupBy("head", "label").agg(F.avg(F.abs("x")).alias("m"))
    profile = m.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "m"))), lambda s: s["m"]).alias("v"))
    return probes.ward_clusters(profile, "head", "v")

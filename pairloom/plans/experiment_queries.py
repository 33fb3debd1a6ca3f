"""Queries over result tables of model runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.plans import experiments as E
from pairloom.plans.registry import query
from pairloom.plans.vector_queries import SH, SV, SZ, long_heads, scores, vecs
from pairloom.session import table


def triple_scores(spark, sf_dir):
    s = scores(spark, sf_dir).withColumn("item", F.floor(F.col("vec_id") / 3).cast("bigint"))
    part = [s.where(f"vec_id % 3 = {k}").select("item", F.col("z").alias(n), *(["gold", "label"] if k == 0 else [])) for k, n in enumerate(("zo", "ze", "zp"))]
    return part[0].join(part[1], "item").join(part[2], "item")


def _m(z: str) -> str:
    return f"({z}[gold + 1] - list_max(list_filter({z}, lambda x, i: i <> gold + 1)))"


def _p(z: str) -> str:
    return f"list_position({z}, list_max({z}))"


TRIPLE = f"{SZ}, t as (select o.vec_id // 3 as item, o.gold, o.label, o.z as zo, e.z as ze, q.z as zp from s o join s e on e.vec_id = o.vec_id + 1 join s q on q.vec_id = o.vec_id + 2 where o.vec_id % 3 = 0), k as (select *, ze[gold + 1] - zo[gold + 1] as d, zp[gold + 1] - zo[gold + 1] as r, {_m('ze')} - {_m('zo')} as dm, {_m('zp')} - {_m('zo')} as rm from t)"


@query(
    "EXT8",
    f"""with {TRIPLE} select item, round(case when abs(d) >= 0.05 then greatest(-3.0, least(3.0, 1 - r / (d + 1e-8))) end, 6) as recovery_logit, round(case when abs(dm) >= 0.05 then greatest(-3.0, least(3.0, 1 - rm / (dm + 1e-8))) end, 6) as recovery_margin,
  {_p('zp')} = {_p('zo')} as pred_matches_orig, {_p('zp')} = {_p('ze')} as pred_matches_cf, abs(d) >= 0.05 as is_significant from k""",
)
def intervention_metrics(spark, sf_dir):
    m = E.intervention_metrics(triple_scores(spark, sf_dir), "zo", "ze", "zp", "gold")
    return m.select("item", F.round("recovery_logit", 6).alias("recovery_logit"), F.round("recovery_margin", 6).alias("recovery_margin"), "pred_matches_orig", "pred_matches_cf", "is_significant")


@query(
    "EXT9 EXT10 AGG15 AGG16",
    f"""with {TRIPLE}, f as (select *, {_p('zp')} = {_p('zo')} as po, {_p('zo')} - 1 = gold as oc, abs(d) >= 0.05 as sig, {_p('zo')} <> {_p('ze')} as fl from k),
u as (select 'all' as stratum, po from f union all select 'orig_correct', po from f where oc union all select 'significant', po from f where sig union all select 'correct_sig', po from f where oc and sig union all select 'answer_flip_pairs', po from f where fl
  union all select 'correctness_flip', po from f where oc <> ({_p('ze')} - 1 = gold))
select stratum, count(*) as n, round(avg(cast(po as integer)), 6) as rate from u group by 1""",
)
def experiment_strata(spark, sf_dir):
    m = E.intervention_metrics(triple_scores(spark, sf_dir), "zo", "ze", "zp", "gold")
    return E.strata_of(m).where("metric = 'pred_matches_orig_rate'").select("stratum", "n", F.round("mean", 6).alias("rate"))


@query("ARR9 ARR15 ARR10", f"with {SH} select label, scope, round(avg(x), 6) as mean, cast(count(*) as bigint) as n from (select label, 'final' as scope, x from h where layer = 7 union all select label, 'all', x from h union all select label, 'span', x from h where layer >= 2 and layer < 4) group by 1, 2")
def pooled_scopes(spark, sf_dir):
    long = vecs(spark, sf_dir).select("vec_id", "label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))).alias("pos", "h"))
    out = E.pooled(long, ["label"], "h", "pos", {"final": F.col("pos") == 7, "all": F.lit(True), "span": F.col("pos").between(2, 3), "none": F.lit(False)})
    mean = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x) / F.size("centroid")
    return out.where("valid and n > 0").select("label", "scope", F.round(mean, 6).alias("mean"), (F.col("n") * 8).cast("bigint").alias("n"))


@query("SRT6", f"with {TRIPLE}, r as (select label, item, row_number() over (partition by label order by cast({_p('zo')} <> {_p('ze')} as integer) desc, abs(d) desc, item) as rank from k) select * from r where rank <= 3")
def example_selection(spark, sf_dir):
    m = E.intervention_metrics(triple_scores(spark, sf_dir), "zo", "ze", "zp", "gold")
    effect = F.abs(F.get("ze", F.col("gold")) - F.get("zo", F.col("gold")))
    top = E.examples(m.withColumn("effect", effect), ["label"], F.col("answer_flip"), F.col("effect"), "item", 3)
    return top.select("label", "item", F.col("rank").cast("bigint").alias("rank"))


@query(
    "VEC28",
    f"""with {SV}, f as (select label, avg(v[1]) as a, avg(v[2]) as b, avg(v[3]) as c, avg(abs(v[4])) as k from v group by label)
select label, a < -0.01 as suggests_bias, b > 0.05 as direction_causal, c < -0.01 as hurts_relevant, round(case when abs(a) > 0.01 then k / abs(a) end, 6) as specificity_ratio, case when abs(a) > 0.01 then k < abs(a) end as is_specific from f""",
)
def verdicts(spark, sf_dir):
    v = lambda i: F.get("v", F.lit(i))
    f = vecs(spark, sf_dir).groupBy("label").agg(F.avg(v(0)).alias("mean_delta_m_add"), F.avg(v(1)).alias("mean_rf_abl"), F.avg(v(2)).alias("mean_delta_m_rel"), F.avg(F.abs(v(3))).alias("ctrl_effect"))
    return E.verdicts(f).select("label", "suggests_bias", "direction_causal", "hurts_relevant", F.round("specificity_ratio", 6).alias("specificity_ratio"), "is_specific")


@query("EXT7 EXT11", f"with {SH}, q as (select label, layer, head, avg(x) as m from h group by 1, 2, 3) select label, layer, round(sqrt(sum(m * m)), 6) as norm, (select count(*) from v where v.label = q.label) as n from q group by label, layer")
def baseline_activations(spark, sf_dir):
    from pairloom.functions.vectors import norm

    rows = vecs(spark, sf_dir).select("label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))).alias("layer", "h"))
    _, own = E.baselines(rows, "label", "layer", "h")
    return own.select("label", "layer", F.round(norm(F.col("centroid")), 6).alias("norm"), "n")


@query("SNK14 AGG13 PRJ29", f"with {SH} select label, layer, round(avg(x), 6) as mean, round(avg(x) - stddev_pop(x) / sqrt(count(*)), 6) as lower, round(avg(x) + stddev_pop(x) / sqrt(count(*)), 6) as upper, count(*) as n from h group by 1, 2")
def curve_data(spark, sf_dir):
    h = E.current_names(long_heads(spark, sf_dir).withColumnRenamed("x", "mass_to_edit_region"))
    out = E.curve_data(h, ["label"], "layer", "edit_mass")
    return out.select("label", "layer", F.round("mean", 6).alias("mean"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "n")


@query("ARR13")
def edit_summaries(spark, sf_dir):
    from pairloom.functions.text import edit_regions

    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.regexp_replace("text", r"\bthe\b", "one").alias("edited"))
    s = E.diff_summary(edit_regions(F.col("text"), F.col("edited")), F.length("text"), F.length("edited"))
    return items.select("item_id", s.alias("s")).select("item_id", "s.*")


RUNS = """r as (select p_brand as family, l_linenumber as layer, case l_partkey % 3 when 0 then 'add' when 1 then 'ablate' else 'control' end as run, l_orderkey // 8 as item, l_discount * 10 as base, l_tax * 10 as original, case when l_quantity > 3 then l_quantity / 10 end as after from lineitem join part on l_partkey = p_partkey),
i as (select distinct family, run = 'control' as c, item from r), m as (select i.*, coalesce(o.item is not null, false) as hit from i left join (select family, item from i where not c) o on o.family = i.family and o.item = i.item),
k as (select family, c, item from (select *, row_number() over (partition by family, c order by hit desc, md5(cast(item as varchar) || ':42'), item) as n from m) where n <= 30), u as (select r.* from r join k on k.family = r.family and k.c = (r.run = 'control') and k.item = r.item),
s as (select family, layer, coalesce(avg(abs(after - base)) filter (where run = 'add'), 0) as added, coalesce(avg(case when abs(original - base) < 0.05 then 0.0 when after is not null then greatest(0.0, (after - base) / (original - base)) end) filter (where run = 'ablate'), 0) as ablated,
  coalesce(avg(abs(after - base)) filter (where run = 'control'), 0) as control from u group by 1, 2)"""


def _runs(spark, sf_dir):
    run = F.when(F.col("l_partkey") % 3 == 0, "add").when(F.col("l_partkey") % 3 == 1, "ablate").otherwise("control")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.select(F.col("p_brand").alias("family"), F.col("l_linenumber").alias("layer"), run.alias("run"), F.expr("l_orderkey div 8").alias("item"), (F.col("l_discount") * 10).alias("base"), (F.col("l_tax") * 10).alias("original"), F.when(F.col("l_quantity") > 3, F.col("l_quantity") / 10).alias("after"))


@query("EXT10 SMP1 JN8", f"with {RUNS} select family, layer, round(added, 6) as added, round(ablated, 5) as ablated, round(control, 6) as control, round(added + ablated - 0.5 * control, 5) as score from s")
def layer_scan(spark, sf_dir):
    """Parts as families, lines as runs."""
    made = E.layer_scores(_runs(spark, sf_dir))
    return made.withColumns({c: F.round(c, 5 if c in ("ablated", "score") else 6) for c in ("added", "ablated", "control", "score")})


@query("EXT10 SRT4", f"with {RUNS} select family, first(layer order by added + ablated - 0.5 * control desc, layer) as layer, round(max(added + ablated - 0.5 * control), 5) as score from s group by 1")
def best_layer(spark, sf_dir):
    return E.best_layers(E.layer_scores(_runs(spark, sf_dir))).withColumn("score", F.round("score", 5))

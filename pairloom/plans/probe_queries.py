"""Queries of probes and their scores, on classes that overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.plans import classification as C
from pairloom.plans import left_out, probe_data, probe_sweep
from pairloom.plans.registry import query
from pairloom.session import table

GUESS = "case when l_quantity < 20 then 'A' when l_quantity < 35 then 'N' else 'R' end"


def _guesses(spark, sf_dir) -> DataFrame:
    guess = F.when(F.col("l_quantity") < 20, "A").when(F.col("l_quantity") < 35, "N").otherwise("R")
    return table(spark, sf_dir, "lineitem").select("l_linenumber", "l_discount", "l_orderkey", F.col("l_returnflag").alias("truth"), guess.alias("guess"))


@query(
    "ST13",
    """with r as (select l_linenumber as layer, l_returnflag = 'R' as y, rank() over (partition by l_linenumber order by l_discount) + (count(*) over (partition by l_linenumber, l_discount) - 1) / 2.0 as r from lineitem),
s as (select layer, sum(r) filter (where y) as r1, cast(count_if(y) as double) as n1, cast(count_if(not y) as double) as n0 from r group by 1)
select layer, round((r1 - n1 * (n1 + 1) / 2) / (n1 * n0), 9) as auroc, cast(n1 as bigint) as n_positive, cast(n0 as bigint) as n_negative from s""",
)
def auroc_by_layer(spark, sf_dir):
    """The discount has few values: most comparisons are ties."""
    rows = _guesses(spark, sf_dir).withColumnRenamed("l_linenumber", "layer")
    return C.auroc(rows, ["layer"], "l_discount", F.col("truth") == "R").withColumn("auroc", F.round("auroc", 9))


@query("ST13 AGG8", f"select l_linenumber, l_returnflag as truth, {GUESS} as guess, count(*) as n from lineitem group by 1, 2, 3")
def confusion_counts(spark, sf_dir):
    return C.confusion(_guesses(spark, sf_dir), ["l_linenumber"])


SCORES = f"""m as (select l_linenumber as g, l_returnflag as y, {GUESS} as p, count(*) as n from lineitem where l_orderkey % 4 = 0 group by 1, 2, 3),
cls as (select g, c, coalesce(sum(n) filter (where c = y), 0)::double as s, coalesce(sum(n) filter (where c = p), 0)::double as q, coalesce(sum(n) filter (where c = y and c = p), 0)::double as h from m, (values ('A'), ('N'), ('R')) v(c) group by 1, 2)"""


@query(
    "ST13",
    f"with {SCORES} select g as l_linenumber, c as class, cast(s as bigint) as support, cast(q as bigint) as predicted, cast(h as bigint) as hits, round(case when q > 0 then h / q end, 9) as precision, round(case when s > 0 then h / s end, 9) as recall, round(2 * h / greatest(s + q, 1), 9) as f1 from cls where s + q > 0",
)
def class_scores(spark, sf_dir):
    made = C.class_scores(C.confusion(_guesses(spark, sf_dir).where(F.col("l_orderkey") % 4 == 0), ["l_linenumber"]), ["l_linenumber"])
    return made.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    "ST13 ST25",
    f"""with {SCORES}, te as (select g, sum(s) as n_test, sum(h) / sum(s) as accuracy, avg(case when s > 0 then h / s end) as balanced, avg(2 * h / greatest(s + q, 1)) as macro, sum(2 * h / greatest(s + q, 1) * s) / sum(s) as weighted from cls where s + q > 0 group by 1),
tr as (select g, sum(n)::double as n_train, max(n) / sum(n)::double as majority, count(*) as k from (select l_linenumber as g, l_returnflag as y, count(*) as n from lineitem where l_orderkey % 4 <> 0 group by 1, 2) group by 1)
select g as l_linenumber, cast(n_train as bigint) as n_train, cast(n_test as bigint) as n_test, k as n_classes, round(accuracy, 9) as accuracy, round(balanced, 9) as balanced_accuracy, round(macro, 9) as macro_f1, round(weighted, 9) as weighted_f1, round(majority, 9) as majority_baseline,
  round(1.0::double / k, 9) as uniform_chance, round(accuracy - majority, 9) as lift_over_majority, round(accuracy - 1.0::double / k, 9) as lift_over_uniform, round((balanced - 1.0::double / k) / (1 - 1.0::double / k), 9) as normalized_gain
from te join tr using (g)""",
)
def class_report(spark, sf_dir):
    rows = _guesses(spark, sf_dir)
    held_out = F.col("l_orderkey") % 4 == 0
    train = rows.where(~held_out).groupBy("l_linenumber", F.col("truth").alias("class")).agg(F.count("*").alias("n"))
    made = C.report(C.confusion(rows.where(held_out), ["l_linenumber"]), ["l_linenumber"], train)
    return made.withColumns({c: F.round(c, 9) for c in made.columns if c not in ("l_linenumber", "n_train", "n_test", "n_classes")})


FAMILIES = ["age", "control", "religion", "sexual_orientation"]


def pairs(spark, sf_dir) -> DataFrame:
    """Vectors next to each other by id as pairs."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    i, names = F.col("vec_id"), F.array(*[F.lit(f) for f in FAMILIES])
    later = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("edited"))
    return e.join(later, "vec_id").select(
        (i % 3).cast("int").alias("layer"), F.get(names, (F.col("label") % 4).cast("int")).alias("family"), F.concat(F.lit("a"), (i % 5).cast("string")).alias("attribute"),
        F.when(i % 7 < 3, "partner").when(i % 7 < 6, "explicit").otherwise("other").alias("context"), F.floor(i / 10).alias("group"), (F.get("v", F.lit(0)) > -0.2).alias("valid"), F.col("v").alias("original"), "edited",
    )


PAIRS = """p as (select a.vec_id as i, a.vec_id % 3 as layer, ['age', 'control', 'religion', 'sexual_orientation'][a.label % 4 + 1] as family, 'a' || a.vec_id % 5 as attribute,
  case when a.vec_id % 7 < 3 then 'partner' when a.vec_id % 7 < 6 then 'explicit' else 'other' end as context, a.vec_id // 10 as grp, a.embedding[1] > -0.2 as valid, a.embedding[1]::double as o, b.embedding[1]::double as e
  from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
c as (select layer, family, attribute from p group by 1, 2, 3 having count(*) >= 12), c2 as (select layer, family from c group by 1, 2 having count(*) >= 2),
f as (select 'focal_vs_control_cf' as task, layer, unnest(case when family = 'control' then ['age', 'religion'] when family in ('age', 'religion') then [family] else [] end) as family, case when family = 'control' then 'control' else 'focal' end as y, grp, e as v from p where valid)"""


@query(
    "ST14",
    f"""with {PAIRS}, t as (
select 'orig_vs_cf' as task, layer, family, 'orig' as y, grp, o as v from p where valid union all select 'orig_vs_cf', layer, family, 'cf', grp, e from p where valid
union all select 'family_identity', layer, 'global', family, grp, e from p where valid
union all select 'within_family_attribute', layer, family, attribute, grp, e from p where valid and (layer, family, attribute) in (select (layer, family, attribute) from c) and (layer, family) in (select (layer, family) from c2)
union all select 'context_split', layer, family, context, grp, e from p where valid and family = 'sexual_orientation' and context <> 'other'
union all select * from f where (layer, family) in (select (layer, family) from f group by layer, family having count(distinct y) = 2))
select task, cast(layer as integer) as layer, family, y, count(*) as n, count(distinct grp) as n_groups, round(sum(v), 5) as first from t group by 1, 2, 3, 4""",
)
def probe_datasets(spark, sf_dir):
    """The five datasets of probes over pairs, counted."""
    parts = [
        probe_data.original_or_edited(pairs(spark, sf_dir)), probe_data.family_identity(pairs(spark, sf_dir), FAMILIES), probe_data.attribute_in_family(pairs(spark, sf_dir), 12),
        probe_data.context_split(pairs(spark, sf_dir), "sexual_orientation"), probe_data.focal_or_control(pairs(spark, sf_dir), ["age", "religion"]),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("task", "layer", "family", "y").agg(F.count("*").alias("n"), F.count_distinct("group").alias("n_groups"), F.round(F.sum(F.get("v", F.lit(0))), 5).alias("first"))


@query("ST14 ST15 SMP8")
def probe_tasks(spark, sf_dir):
    """All five tasks of all layers in one sweep, over the whole vectors."""
    rows = probe_data.every_task(pairs(spark, sf_dir), FAMILIES, 12, "sexual_orientation")
    return probe_sweep.sweep(rows, ["task", "family", "layer"], "v", "y", "group")


def _banded(spark, sf_dir, y: F.Column) -> DataFrame:
    """Orders with a class that depends on the band of the customer, not wholly; the band as three indicators."""
    band = F.col("o_custkey") % 3
    one_hot = F.array(*[(band == i).cast("double") for i in range(3)])
    return table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("layer"), F.col("o_orderkey").alias("group"), one_hot.alias("v"), y.alias("y"))


SPLIT = "cast('0x' || substr(md5(cast(o_orderkey as varchar) || ':42'), 1, 8) as bigint) / 4294967296.0 < 0.3"
BANDED = """t as (select substr(o_orderpriority, 1, 1) as layer, o_custkey % 3 as b, {y} as y, {split} as te from orders),
tr as (select layer, b, y, count(*) as n from t where not te group by 1, 2, 3), cell as (select layer, b, arg_max(y, n) as p, sum(n) filter (where y = 'lo')::double / sum(n) as c from tr group by 1, 2)"""
TWO = "case when o_totalprice > 90000 + 60000 * (o_custkey % 3) then 'hi' else 'lo' end"
THREE = "case when o_totalprice > 90000 + 70000 * (o_custkey % 3) then 'hi' when o_totalprice > 20000 + 60000 * (o_custkey % 3) then 'mid' else 'lo' end"


@query(
    "ST13 ST15 SMP8",
    f"""with {BANDED.format(y=TWO, split=SPLIT)}, m as (select layer, y, p, c from t join cell using (layer, b) where te),
r as (select layer, y, rank() over (partition by layer order by c) + (count(*) over (partition by layer, c) - 1) / 2.0 as r from m),
a as (select layer, (sum(r) filter (where y = 'lo') - count_if(y = 'lo') * (count_if(y = 'lo') + 1) / 2) / (count_if(y = 'lo') * count_if(y <> 'lo')) as auroc from r group by 1),
k as (select layer, max(n) / sum(n)::double as majority from (select layer, y, count(*) as n from t where not te group by 1, 2) group by 1)
select layer, count(*) as n_test, round(count_if(y = p) / count(*)::double, 6) as accuracy, round((count_if(y = p and y = 'hi') / count_if(y = 'hi')::double + count_if(y = p and y = 'lo') / count_if(y = 'lo')::double) / 2, 6) as balanced_accuracy,
  round(2.0::double * count_if(y = p and y = 'lo') / (count_if(y = 'lo') + count_if(p = 'lo')), 6) as f1, round(any_value(auroc), 6) as auroc, round(count_if(y = p) / count(*)::double - any_value(majority), 6) as lift_over_majority
from m join a using (layer) join k using (layer) group by layer""",
)
def probe_of_bands(spark, sf_dir):
    """Indicators and hardly any ridge: a probe's chances are the frequencies in the training rows."""
    y = F.when(F.col("o_totalprice") > 90000 + 60000 * (F.col("o_custkey") % 3), "hi").otherwise("lo")
    made = probe_sweep.sweep(_banded(spark, sf_dir, y), ["layer"], "v", "y", "group", c=1e5)
    return made.select("layer", "n_test", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "f1", "auroc", "lift_over_majority")])


@query(
    "ST13 ST15 SMP8",
    f"""with {BANDED.format(y=THREE, split=SPLIT)}, m as (select layer, y, p from t join cell using (layer, b) where te), cls as (
  select layer, c, count_if(y = c)::double as s, count_if(p = c)::double as q, count_if(y = c and p = c)::double as h from m, (values ('hi'), ('lo'), ('mid')) v(c) group by 1, 2)
select layer, cast(sum(s) as bigint) as n_test, round(sum(h) / sum(s), 6) as accuracy, round(avg(case when s > 0 then h / s end), 6) as balanced_accuracy, round(avg(2 * h / (s + q)), 6) as macro_f1, round(sum(2 * h / (s + q) * s) / sum(s), 6) as weighted_f1
from cls where s + q > 0 group by 1""",
)
def probe_of_three_classes(spark, sf_dir):
    k = F.col("o_custkey") % 3
    y = F.when(F.col("o_totalprice") > 90000 + 70000 * k, "hi").when(F.col("o_totalprice") > 20000 + 60000 * k, "mid").otherwise("lo")
    made = probe_sweep.sweep(_banded(spark, sf_dir, y), ["layer"], "v", "y", "group", c=1e5)
    return made.select("layer", "n_test", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


def _segments(spark, sf_dir) -> DataFrame:
    band = F.col("c_nationkey") % 3
    one_hot = F.array(*[(band == i).cast("double") for i in range(3)])
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 2).alias("fold"), (F.col("c_acctbal") > 1000 + 3000 * band).alias("y"), one_hot.alias("v"))


@query(
    "ST11 ST16 SMP9",
    """with t as (select c_custkey % 2 as fold, c_nationkey % 3 as b, c_acctbal > 1000 + 3000 * (c_nationkey % 3) as y from customer), n as (select fold, b, count(*) as n, count_if(y) as k from t group by 1, 2)
select fold, round(count_if(y = (2 * (k - y::int) > n - 1)) / count(*)::double, 9) as accuracy, cast(count_if(y = (2 * (k - y::int) > n - 1)) as bigint) as hits, count(*) as n from t join n using (fold, b) group by fold""",
)
def left_out_bands(spark, sf_dir):
    """Of indicators and hardly any ridge, each row's probe guesses the majority among the others of its band."""
    found, _ = left_out.leave_one_out(_segments(spark, sf_dir), "fold", "v", "y", None, 1e4)
    return found.withColumn("accuracy", F.round("accuracy", 9))


@query("ST16 SMP9")
def head_probe_ranking(spark, sf_dir):
    """Components of the vectors as heads: which of them a probe of the lower labels uses."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 2).alias("fold"), (F.col("label") < 5).alias("y"), F.col("embedding").alias("v"))
    _, coefs = left_out.leave_one_out(rows, "fold", "v", "y", None, 0.1)
    return left_out.ranked_coefficients(coefs, "fold")

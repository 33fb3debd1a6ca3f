"""Queries of operators that need Python or resampling, on inputs whose result has a closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.functions import text as X
from pairloom.operators import nested, rules, sampling, sets, windows
from pairloom.operators.quality import high_edits
from pairloom.plans import probes
from pairloom.plans import statistics as T
from pairloom.plans.experiments import diff_summary
from pairloom.plans.registry import query
from pairloom.session import table

EDITED = "case when c_custkey % 3 = 0 then '' when c_custkey % 3 = 1 then ' zz' else repeat('#', 30) end"


@query(
    "STR11 STR12 STR13 ARR13 DQ5",
    f"""with t as (select c_custkey, c_name as a, length({EDITED}) as k, length(c_name) as n, {EDITED} as e from customer)
select c_custkey, round(1 - 2.0 * n / (2 * n + k), 6) as ratio, cast(case when k = 0 then 0 else 1 end as integer) as n_edit_regions, cast(k as integer) as n_changed,
  round(k / cast(n + k as double), 6) as edit_ratio, case when k > 0 then 'insert' end as tag, case when k = 0 then '' else '--- original' || chr(10) || '+++ edited' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-' || a || chr(10) || '+' || a || e end as diff, 1 - 2.0 * n / (2 * n + k) > 0.35 as high from t""",
)
def text_edits(spark, sf_dir):
    """Names with something appended: one insertion at the end."""
    tail = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).when(F.col("c_custkey") % 3 == 1, F.lit(" zz")).otherwise(F.lit("#" * 30))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("a"), F.concat("c_name", tail).alias("b"))
    made = rows.withColumns({"r": X.edit_ratio(F.col("a"), F.col("b")), "g": X.edit_regions(F.col("a"), F.col("b")), "diff": X.line_diff(F.col("a"), F.col("b"))})
    made = made.withColumn("s", diff_summary(F.col("g"), F.length("a"), F.length("b")))
    high = high_edits(made, "r").select("c_custkey", F.lit(True).alias("high"))
    out = made.join(high, "c_custkey", "left")
    return out.select("c_custkey", F.round("r", 6).alias("ratio"), "s.n_edit_regions", "s.n_changed", F.round("s.edit_ratio", 6).alias("edit_ratio"), F.get("g", F.lit(0))["tag"].alias("tag"), "diff", F.coalesce("high", F.lit(False)).alias("high"))


@query(
    "AGG34",
    """with t as (select c_mktsegment, 1 - 2.0 * length(c_name) / (2 * length(c_name) + c_custkey % 4) as r from customer) select c_mktsegment, round(avg(r), 6) as mean, round(max(r), 6) as most, count(*) as n from t group by 1""",
)
def edit_ratio_by_category(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_mktsegment", F.col("c_name").alias("a"), F.concat("c_name", F.repeat(F.lit("~"), (F.col("c_custkey") % 4).cast("int"))).alias("b"))
    made = rows.withColumn("r", X.edit_ratio(F.col("a"), F.col("b")))
    return made.groupBy("c_mktsegment").agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.max("r"), 6).alias("most"), F.count("*").alias("n"))


@query("ARR6", "select p_partkey, case when p_size % 3 = 0 then 2 when p_size % 3 = 1 then 1 end as at from part")
def stem_offsets(spark, sf_dir):
    """The stem as it is, with its first token merged into the one before, and another text."""
    k, size = F.col("p_partkey").cast("int"), F.col("p_size") % 3
    arr = lambda *xs: F.array(*[x if not isinstance(x, int) else F.lit(x) for x in xs]).cast("array<int>")
    tokens = F.when(size == 0, arr(-1, -2, k, k + 1, k + 2, -9)).when(size == 1, arr(-1, -7, k + 1, k + 2, -9)).otherwise(arr(-1, -2, -3))
    rows = table(spark, sf_dir, "part").select("p_partkey", tokens.alias("t"), arr(k, k + 1, k + 2).alias("s"))
    return rows.select("p_partkey", A.stem_offset(F.col("t"), F.col("s")).alias("at"))


@query("ARR8", "select n_nationkey, list_transform(range(length(n_name)), lambda i: case when i = 3 then -1 when i < 3 then 0 else 1 end) as token from nation")
def token_map(spark, sf_dir):
    """Two tokens with a blank between them, at place 3."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.lit(0), F.lit(4)).alias("s"), F.array(F.lit(3), F.length("n_name")).alias("e"), F.length("n_name").alias("n"))
    return rows.select("n_nationkey", A.char_to_token("s", "e", "n").alias("token"))


@query("ARR1", "select n_regionkey as k, case when n_nationkey % 2 = 0 then 'even' else 'odd' end as category, n_name as label, n_nationkey as value from nation")
def map_of_maps(spark, sf_dir):
    side = F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd")
    inner = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k"), side.alias("category")).agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    outer = inner.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("category", "m"))).alias("variants"))
    return nested.map_rows(outer, "variants", ("k",))


@query("SET3", "select s_suppkey, [s_name || ':a', s_name || ':b', 'x:a'] as spans from supplier")
def first_spans(spark, sf_dir):
    span = lambda s, r: F.struct(s.alias("span"), F.lit(r).alias("role"), F.rand().alias("offset"))
    name = F.col("s_name")
    given = F.array(span(name, "a"), span(name, "b"), span(name, "a"), span(F.lit("x"), "a"), span(name, "b"))
    kept = sets.distinct_spans(given)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.transform(kept, lambda s: F.concat_ws(":", s["span"], s["role"])).alias("spans"))


@query("SRT2", "select * from (select c_mktsegment, c_custkey, cast(row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as bigint) as rank from customer) where rank <= 5")
def largest_first(spark, sf_dir):
    top = windows.top_k(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], 5)
    return top.select("c_mktsegment", "c_custkey", F.col("rank").cast("bigint").alias("rank"))


@query("PRJ27", "select l_linenumber * 4 as layer, case when l_linenumber * 4 < 8 then 'q1' when l_linenumber * 4 < 16 then 'q2' when l_linenumber * 4 < 24 then 'q3' else 'q4' end as region, count(*) as n from lineitem group by 1, 2")
def quarter_regions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") * 4).alias("layer"))
    return rows.select("layer", rules.quarter_region(F.col("layer"), 32).alias("region")).groupBy("layer", "region").agg(F.count("*").alias("n"))


@query("FLT14", "select count(*) filter (where n_nationkey % 3 = 0) as texts, count(*) as n from nation")
def blank_texts(spark, sf_dir):
    said = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.lit("  "))
    return table(spark, sf_dir, "nation").agg(F.count(X.blank_to_null(said)).alias("texts"), F.count("*").alias("n"))


@query(
    "ST10",
    """with v as (select embedding[1] as x, embedding[2] as y from embeddings), c as (select var_samp(x) as a, var_samp(y) as b, covar_samp(x, y) as k from v)
select round(((a + b) / 2 + sqrt(((a - b) / 2) * ((a - b) / 2) + k * k)) / (a + b), 6) as first, round(((a + b) / 2 - sqrt(((a - b) / 2) * ((a - b) / 2) + k * k)) / (a + b), 6) as second from c""",
)
def pca_plane(spark, sf_dir):
    """Two dimensions: the variances along the axes are the roots of a quadratic equation."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v"))
    _, shares = probes.principal_components(rows, "v", 2, "vec_id")
    return spark.createDataFrame([tuple(round(s, 6) for s in shares)], "first double, second double")


@query(
    "ST26",
    """with v as (select vec_id, embedding[1] as x, embedding[2] as y from embeddings), s as (select avg(x) as mx, avg(y) as my, stddev_pop(x) as sx, stddev_pop(y) as sy from v)
select vec_id, round(greatest(-3, least(3, (x - mx) / sx)), 5) as zx, round(greatest(-3, least(3, (y - my) / sy)), 5) as zy from v, s""",
)
def standard_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 2).alias("v"))
    return probes.standardised(rows, "v", "vec_id").select("vec_id", F.round(F.get("z", F.lit(0)), 5).alias("zx"), F.round(F.get("z", F.lit(1)), 5).alias("zy"))


def _apart(spark, sf_dir):
    """Vectors of two classes far apart: every probe must be right."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 4).alias("layer"), (F.col("vec_id") % 2).alias("y"), F.slice(F.col("embedding").cast("array<double>"), 1, 4).alias("v"))
    return rows.withColumn("v", F.concat(F.col("v"), F.array((F.col("y") * 40 - 20).cast("double"))))


@query("ST13 ST14 ST15 SMP8", "select label % 4 as layer, 1.0 as accuracy, 1.0 as balanced_accuracy, 1.0 as macro_f1, count(*) as n from embeddings group by 1")
def separable_probes(spark, sf_dir):
    out = probes.layer_probes(_apart(spark, sf_dir), "layer", "v", "y", "vec_id")
    return out.select("layer", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1")], (F.col("n_train") + F.col("n_test")).alias("n"))


@query("ST11 ST16 SMP9", "select label % 4 as layer, 1.0 as accuracy, count(*) as n from embeddings group by 1")
def separable_left_out(spark, sf_dir):
    return probes.leave_one_out(_apart(spark, sf_dir), "layer", "v", "y", 3).withColumn("accuracy", F.round("accuracy", 6))


@query("ST18", "select n_nationkey, cast(n_regionkey + 1 as bigint) as cluster_5 from nation")
def ward_of_regions(spark, sf_dir):
    """Directions of five groups at right angles: the cut at five finds them, named by their least member."""
    first = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("low"))
    place = F.array(*[(F.col("n_regionkey") == i).cast("double") * (10 + F.col("n_nationkey") / 10) for i in range(5)])
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", place.alias("v"))
    found = probes.ward_clusters(rows, "n_nationkey", "v", (5,))
    named = found.join(rows.select("n_nationkey", "n_regionkey"), "n_nationkey").join(first, "n_regionkey")
    of = named.groupBy("cluster_5").agg(F.min("n_regionkey").alias("one"), F.max("n_regionkey").alias("other"))
    return named.join(of, "cluster_5").where("one = other").select("n_nationkey", (F.col("one") + 1).cast("bigint").alias("cluster_5"))


@query("ST25 AGG26", "select n_name, case n_regionkey when 0 then 'early' when 1 then 'mid' else 'late' end as region, case when n_name < 'F' then n_regionkey <> 1 when n_name < 'M' then n_regionkey = 1 end as aligned from nation")
def region_alignment(spark, sf_dir):
    region = F.when(F.col("n_regionkey") == 0, "early").when(F.col("n_regionkey") == 1, "mid").otherwise("late")
    family = F.when(F.col("n_name") < "F", "a").when(F.col("n_name") < "M", "b").otherwise("c")
    peaks = table(spark, sf_dir, "nation").select("n_name", region.alias("region"), family.alias("family"))
    return T.alignment_with_expected(peaks, "family", "region", {"a": ["early", "late"], "b": ["mid"]}).select("n_name", "region", "aligned")


@query("ST1", "select l_returnflag, round(avg(l_quantity), 6) as mean, true as inside, true as narrow from lineitem group by 1")
def bootstrap_brackets(spark, sf_dir):
    """The interval holds the mean, and is as wide as the normal one within a fifth."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    got = T.bootstrap(rows, "l_returnflag", "l_quantity", draws=2000)
    wide = rows.groupBy("l_returnflag").agg((2 * 1.959964 * F.stddev_samp("l_quantity") / F.sqrt(F.count("*"))).alias("w"))
    return got.join(wide, "l_returnflag").select("l_returnflag", F.round("mean", 6).alias("mean"), ((F.col("lo") < F.col("mean")) & (F.col("mean") < F.col("hi"))).alias("inside"), (F.abs((F.col("hi") - F.col("lo")) / F.col("w") - 1) < 0.2).alias("narrow"))


@query(
    "ST3 ST23 SMP5",
    """with r as (select l_linestatus, l_quantity as q, l_returnflag = 'R' as a from lineitem where l_returnflag in ('R', 'N'))
select l_linestatus, round(avg(q) filter (where a) - avg(q) filter (where not a), 6) as difference, count(*) as n, true as in_range from r group by 1 having count_if(a) > 0 and count_if(not a) > 0""",
)
def permutation_differences(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N")).select("l_linestatus", "l_quantity", "l_returnflag")
    out = T.permutation(rows, "l_linestatus", "l_quantity", F.col("l_returnflag") == "R", draws=500)
    return out.where(~F.isnan("difference")).select("l_linestatus", F.round("difference", 6).alias("difference"), "n", F.col("p").between(0, 1).alias("in_range"))


@query("SMP5 ST23", "select l_returnflag, (select min(n) from (select count(*) as n from lineitem group by l_returnflag)) as n from lineitem group by 1")
def equal_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber").alias("id"), "l_returnflag")
    return sampling.equalised(rows, "l_returnflag", "id").groupBy("l_returnflag").agg(F.count("*").alias("n"))

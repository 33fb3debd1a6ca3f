"""Queries over tests and effect sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.plans import statistics as T
from pairloom.plans.registry import query
from pairloom.session import table

RANK = "rank() over ({g} order by {c}) + (count(*) over ({p} {c}) - 1) / 2.0"


def _rank(column: str, group: str | None = None) -> str:
    return RANK.format(c=column, g=f"partition by {group}" if group else "", p=f"partition by {group}," if group else "partition by")


@query(
    "ST2 ST21",
    "select l_linestatus, round((avg(l_quantity) filter (where l_returnflag = 'R') - avg(l_quantity) filter (where l_returnflag = 'N')) / sqrt(((count(*) filter (where l_returnflag = 'R') - 1) * var_samp(l_quantity) filter (where l_returnflag = 'R') + (count(*) filter (where l_returnflag = 'N') - 1) * var_samp(l_quantity) filter (where l_returnflag = 'N')) / (count(*) filter (where l_returnflag in ('R', 'N')) - 2)), 6) as d, round(avg(l_quantity) filter (where l_returnflag = 'R') - avg(l_quantity) filter (where l_returnflag = 'N'), 6) as difference from lineitem group by 1",
)
def cohens_d(spark, sf_dir):
    r, n, x = F.col("l_returnflag") == "R", F.col("l_returnflag") == "N", F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(T.cohens_d(x, r, n), 6).alias("d"), F.round(F.avg(F.when(r, x)) - F.avg(F.when(n, x)), 6).alias("difference"))


@query("ST5 ST22", f"with r as (select o_orderpriority as g, {_rank('o_totalprice', 'o_orderpriority')} as a, {_rank('o_custkey', 'o_orderpriority')} as b from orders) select g as o_orderpriority, round(corr(a, b), 6) as rho, count(*) as n from r group by g having count(*) >= 10")
def spearman(spark, sf_dir):
    return T.spearman(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"]).where("n >= 10").withColumn("rho", F.round("rho", 6))


@query(
    "ST4",
    f"""with r as (select l_returnflag as g, {_rank('l_quantity', 'l_returnflag')} as x, {_rank('l_extendedprice', 'l_returnflag')} as y, {_rank('l_discount', 'l_returnflag')} as z from lineitem),
c as (select g, corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz, count(*) as n from r group by g) select g as l_returnflag, round((xy - xz * yz) / (sqrt(1 - xz * xz) * sqrt(1 - yz * yz)), 6) as rho, n from c""",
)
def partial_spearman(spark, sf_dir):
    out = T.partial_spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", ["l_returnflag"])
    return out.select("l_returnflag", F.round("rho", 6).alias("rho"), "n")


@query(
    "ST6",
    f"""with f as (select l_linestatus as g, l_quantity as q, l_returnflag = 'R' as a from lineitem where l_returnflag in ('R', 'N')), r as (select g, a, {_rank('q', 'g')} as r, cast(count(*) over (partition by g, q) as double) as t from f),
s as (select g, sum(r) filter (where a) as r1, cast(count_if(a) as double) as n1, cast(count_if(not a) as double) as n2, sum(t * t - 1) as ties from r group by g)
select g as l_linestatus, round(r1 - n1 * (n1 + 1) / 2, 3) as u, round((r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) as z, cast(n1 as bigint) as n1, cast(n2 as bigint) as n2 from s""",
)
def mann_whitney(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N")).select("l_linestatus", "l_quantity", "l_returnflag")
    out = T.mann_whitney(rows, "l_quantity", F.col("l_returnflag") == "R", ["l_linestatus"])
    return out.select("l_linestatus", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"), "n1", "n2")


@query(
    "ST7 JN6",
    f"""with d as (select l_orderkey as k, avg(l_quantity) filter (where l_returnflag = 'R') - avg(l_quantity) filter (where l_returnflag = 'N') as d from lineitem group by 1), n as (select round(d, 6) as d, abs(round(d, 6)) as a from d where d is not null and round(d, 6) <> 0),
r as (select d, {_rank('a')} as r, cast(count(*) over (partition by a) as double) as t from n), s as (select sum(case when d > 0 then r else 0 end) as w, cast(count(*) as double) as n, sum(t * t - 1) as ties from r)
select round(w, 3) as w, cast(n as bigint) as n, round((w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) as z from s""",
)
def wilcoxon(spark, sf_dir):
    from pairloom.operators.joins import paired_means

    d = paired_means(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_returnflag") == "N", F.col("l_quantity"))
    out = T.wilcoxon(d.select(F.round("difference", 6).alias("d")), "d")
    return out.select(F.round("w", 3).alias("w"), "n", F.round("z", 6).alias("z"))


@query(
    "ST9",
    "with h as (select l_orderkey as k, l_linenumber as i, avg(l_quantity) as v from lineitem group by 1, 2) select a.i as a, b.i as b, round(corr(a.v, b.v), 6) as r, count(*) as n from h a join h b on a.k = b.k and a.i <= b.i group by 1, 2",
)
def pearson_matrix(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.avg("l_quantity").alias("v"))
    return T.pearson_matrix(h, "l_orderkey", "l_linenumber", "v").withColumn("r", F.round("r", 6))


@query("ST1 ST23")
def bootstrap_ci(spark, sf_dir):
    return T.bootstrap(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity", draws=500)


@query("ST3 ST23")
def permutation_p(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N")).select("l_linestatus", "l_quantity", "l_returnflag")
    return T.permutation(rows, "l_linestatus", "l_quantity", F.col("l_returnflag") == "R", draws=5000)


@query("ST4 ST6")
def tail_probabilities(spark, sf_dir):
    z = T.mann_whitney(table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "N")).select("l_linestatus", "l_quantity", "l_returnflag"), "l_quantity", F.col("l_returnflag") == "R", ["l_linestatus"])
    t = T.partial_spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", ["l_returnflag"])
    return z.select(F.col("l_linestatus").alias("group"), T.normal_upper(F.col("z")).alias("p")).union(t.select("l_returnflag", T.t_two_sided(F.col("t"), (F.col("n") - 3).cast("double"))))

"""Queries of resampling: values in closed form, intervals and p beside their normal limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.counts import quantiles
from pairloom.plans import resampling as R
from pairloom.plans.registry import query
from pairloom.session import table


def _within(lo: Column, hi: Column, width: Column, part: float) -> Column:
    """Whether an interval is as wide as the normal limit says, within a part of it."""
    return F.abs((hi - lo) / width - 1) < part


@query(
    "ST1 AGG6",
    "select l_returnflag, round(median(l_extendedprice), 6) as value, count(*) as n, true as inside, true as as_wide from lineitem group by 1",
)
def bootstrap_medians(spark, sf_dir):
    """As wide as a median's normal limit, 1.96 / (f sqrt n) with the density f between near quantiles, within 30 %."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    got = R.bootstrap(rows, ["l_returnflag"], "l_extendedprice", R.MEDIAN, draws=400)
    near = quantiles(rows, ["l_returnflag"], "l_extendedprice", [0.4, 0.6]).select("l_returnflag", ((F.get("q", F.lit(1)) - F.get("q", F.lit(0))) / 0.2 * 1.96 / F.sqrt("n")).alias("w"))
    out = got.join(near, "l_returnflag")
    return out.select("l_returnflag", F.round("value", 6).alias("value"), "n", F.col("value").between(F.col("lo"), F.col("hi")).alias("inside"), _within(F.col("lo"), F.col("hi"), F.col("w"), 0.3).alias("as_wide"))


EFFECT = """(avg({x}) filter (where {a}) - avg({x}) filter (where not {a})) / sqrt(((count_if({a}) - 1) * var_samp({x}) filter (where {a}) + (count_if(not {a}) - 1) * var_samp({x}) filter (where not {a})) / (count(*) - 2))"""


@query(
    "ST1 ST2",
    f"""select l_linenumber, round({EFFECT.format(x="l_extendedprice", a="l_quantity > 25")}, 6) as value, count(*) as n, true as inside, true as as_wide from lineitem group by 1""",
)
def bootstrap_effects(spark, sf_dir):
    """Cohen's d of prices above and below a quantity; as wide as its normal limit, within 30 %."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_extendedprice", (F.col("l_quantity") > 25).alias("a"))
    got = R.bootstrap(rows, ["l_linenumber"], "l_extendedprice", R.COHENS_D, F.col("a"), draws=400)
    n = rows.groupBy("l_linenumber").agg(F.count_if("a").cast("double").alias("na"), F.count_if(~F.col("a")).cast("double").alias("nb"))
    out = got.join(n, "l_linenumber")
    width = 2 * 1.96 * F.sqrt((F.col("na") + F.col("nb")) / (F.col("na") * F.col("nb")) + F.col("value") ** 2 / (2 * (F.col("na") + F.col("nb"))))
    return out.select("l_linenumber", F.round("value", 6).alias("value"), "n", F.col("value").between(F.col("lo"), F.col("hi")).alias("inside"), _within(F.col("lo"), F.col("hi"), width, 0.3).alias("as_wide"))


SHIFTED = "l_quantity + case when l_linenumber in (1, 3) and l_orderkey % 2 = 0 then 6 else 0 end"


def _shifted(spark, sf_dir) -> DataFrame:
    """Quantities of even and odd orders; at two line numbers those of even ones are six more."""
    even = F.col("l_orderkey") % 2 == 0
    more = F.when(F.col("l_linenumber").isin(1, 3) & even, 6).otherwise(0)
    return table(spark, sf_dir, "lineitem").select("l_linenumber", even.alias("even"), (F.col("l_quantity") + more).alias("x"))


@query(
    "ST3",
    f"select l_linenumber, round(median({SHIFTED}) filter (where l_orderkey % 2 = 0) - median({SHIFTED}) filter (where l_orderkey % 2 <> 0), 6) as difference, l_linenumber in (1, 3) as differs, count(*) as n from lineitem group by 1",
)
def permuted_medians(spark, sf_dir):
    """A shift by six is found where it is, and nowhere else."""
    got = R.permutation(_shifted(spark, sf_dir), ["l_linenumber"], "x", F.col("even"), R.MEDIAN, draws=1000)
    return got.select("l_linenumber", F.round("difference", 6).alias("difference"), (F.col("p") < 0.002).alias("differs"), "n")


@query(
    "ST3 ST2",
    f"""select l_linenumber, round({EFFECT.format(x=f"({SHIFTED})", a="l_orderkey % 2 = 0")}, 6) as difference, true as as_normal, count(*) as n from lineitem group by 1""",
)
def permuted_effects(spark, sf_dir):
    """p within 0.06 of that of the normal limit, 2 (1 - Phi(|d| / sqrt(1 / na + 1 / nb)))."""
    from pairloom.plans.statistics import normal_upper

    rows = _shifted(spark, sf_dir)
    got = R.permutation(rows, ["l_linenumber"], "x", F.col("even"), R.COHENS_D, draws=1000)
    n = rows.groupBy("l_linenumber").agg((1 / F.count_if("even") + 1 / F.count_if(~F.col("even"))).alias("s"))
    out = got.join(n, "l_linenumber").withColumn("limit", 2 * normal_upper(F.abs("difference") / F.sqrt("s")))
    return out.select("l_linenumber", F.round("difference", 6).alias("difference"), (F.abs(F.col("p") - F.col("limit")) < 0.06).alias("as_normal"), "n")


@query(
    "ST23 SMP5 ST1 ST2 ST3",
    f"""with r as (select l_returnflag as g, l_quantity as q, l_extendedprice as e, row_number() over (partition by l_returnflag order by md5(k || ':42') || k) as r from (select *, cast(l_orderkey * 10 + l_linenumber as varchar) as k from lineitem)),
s as (select * from r where r <= (select min(n) from (select count(*) as n from r group by g))), f as (select unnest(['A', 'N']) as f), m as (select f as "group", g = f as a, 'l_quantity' as metric, q as x from s join f on g = f or g = 'R' union all select f, g = f, 'l_extendedprice', e from s join f on g = f or g = 'R')
select "group", metric, round(avg(x) filter (where a), 6) as value, round({EFFECT.format(x="x", a="a")}, 6) as cohens_d, count_if(a) as n, true as inside, true as as_normal from m group by 1, 2""",
)
def n_adjusted_report(spark, sf_dir):
    """Flags A and N against R, each cut to the size of the smallest; p within 0.06 of its normal limit."""
    from pairloom.plans.statistics import normal_upper

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", "l_quantity", "l_extendedprice")
    got = R.n_adjusted(rows, "l_returnflag", "id", ["l_quantity", "l_extendedprice"], "R", draws=400, permutations=1000)
    limit = 2 * normal_upper(F.abs("cohens_d") * F.sqrt(F.col("n") / 2))
    return got.select("group", "metric", F.round("value", 6).alias("value"), F.round("cohens_d", 6).alias("cohens_d"), "n", F.col("value").between(F.col("lo"), F.col("hi")).alias("inside"), (F.abs(F.col("p") - limit) < 0.06).alias("as_normal"))

"""Queries over joins, sets, aggregates, windows and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.operators import aggregates as G
from pairloom.operators import joins as J
from pairloom.operators import sampling as S
from pairloom.operators import sets as Z
from pairloom.operators import windows as W
from pairloom.plans.registry import query
from pairloom.session import table

# ---------------------------------------------------------------- joins


@query(
    "JN1 JN2 T8",
    """
with last as (select l_orderkey, l_linenumber, l_quantity, l_returnflag from (select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_quantity desc) as r from lineitem) where r = 1),
first as (select l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as r from lineitem where l_returnflag = 'R') where r = 1)
select o_orderkey, l.l_quantity as last_quantity, f.l_quantity as first_returned, f.l_orderkey is not null as has_return
from orders join last l on o_orderkey = l.l_orderkey left join first f on o_orderkey = f.l_orderkey""",
)
def pair_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    last = J.dedupe_last(lines.withColumn("q", F.col("l_quantity")), ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "q"]).select("o_orderkey", F.col("l_quantity").alias("last_quantity"))
    returned = lines.where("l_returnflag = 'R'").withColumns({c: -F.col(n) for c, n in (("a", "l_linenumber"), ("b", "l_partkey"), ("c", "l_suppkey"), ("d", "l_quantity"))})
    first = J.dedupe_last(returned, ["o_orderkey"], ["a", "b", "c", "d"]).select("o_orderkey", F.col("l_quantity").alias("first_returned"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return J.optional_join(orders.join(last, "o_orderkey"), first, "o_orderkey", "has_return").select("o_orderkey", "last_quantity", "first_returned", "has_return")


@query(
    "JN3 JN4",
    """
select c_custkey, coalesce(a.v, b.v, 0.0) as balance from customer
left join (select s_suppkey, s_acctbal as v from supplier where s_suppkey % 2 = 0) a on c_custkey = a.s_suppkey
left join (select n_nationkey, cast(n_regionkey as double) as v from nation where n_nationkey < 10) b on c_nationkey = b.n_nationkey""",
)
def fallback_lookup(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    a = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("double").alias("balance"))
    return J.fallback_join(customers, a, b, "c_custkey", "c_nationkey", "balance", F.lit(0.0)).select("c_custkey", "balance")


@query("JN5 JN15", "select user_id from events where event_type in ('signup', 'purchase', 'error') group by user_id having count(distinct event_type) = 3")
def relational_division(spark, sf_dir):
    return J.in_all(table(spark, sf_dir, "events"), "user_id", "event_type", parts=["signup", "purchase", "error"])


@query(
    "JN6",
    """
select * from (select l_orderkey, round(avg(l_quantity) filter (where l_returnflag = 'R'), 6) as focal, round(avg(l_quantity) filter (where l_returnflag = 'N'), 6) as control,
  round(avg(l_quantity) filter (where l_returnflag = 'R') - avg(l_quantity) filter (where l_returnflag = 'N'), 6) as difference from lineitem group by l_orderkey)
where focal is not null and control is not null""",
)
def paired_difference(spark, sf_dir):
    d = J.paired_means(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_returnflag") == "N", F.col("l_quantity"))
    return d.withColumns({c: F.round(c, 6) for c in ("focal", "control", "difference")})


@query(
    "JN7",
    """
with h as (select l_orderkey as k, l_linenumber as head, avg(l_tax) as v from lineitem where l_returnflag = 'R' group by 1, 2), g as (select l_orderkey as k, l_linenumber as head, avg(l_discount) as v from lineitem where l_linestatus = 'O' group by 1, 2)
select h.k as l_orderkey, h.head, round(h.v, 6) as v_edit, round(g.v, 6) as v_final from h join g on h.k = g.k and h.head = g.head""",
)
def suffixed_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("head", F.col("l_linenumber"))
    a = lines.where("l_returnflag = 'R'").groupBy("l_orderkey", "head").agg(F.avg("l_tax").alias("v_edit"))
    b = lines.where("l_linestatus = 'O'").groupBy("l_orderkey", "head").agg(F.avg("l_discount").alias("v_final"))
    return a.join(b, ["l_orderkey", "head"]).withColumns({"v_edit": F.round("v_edit", 6), "v_final": F.round("v_final", 6)})


@query(
    "JN8 SMP6",
    """
select o_orderkey, matched from (select o_orderkey, o_custkey in (select o_custkey from orders where o_orderstatus = 'P') as matched from orders where o_orderstatus = 'F')
order by matched desc, md5(cast(o_orderkey as varchar) || ':42'), o_orderkey limit 500""",
)
def matched_controls(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return J.matched_first(orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "o_custkey", S.hash_order("o_orderkey"), 500).select("o_orderkey", "matched")


@query("JN9", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def semi_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.not_done(table(spark, sf_dir, "customer").select("c_custkey"), done, ["c_custkey"])


@query(
    "JN11 SET12",
    """
select 'rebuilt' as part, count(*) as n from (select distinct l_suppkey from lineitem) k join supplier on l_suppkey = s_suppkey where l_suppkey % 3 <> 0
union all select 'unmatched', count(*) from (select distinct l_suppkey from lineitem) k where l_suppkey % 3 <> 0 and l_suppkey not in (select s_suppkey from supplier)""",
)
def rebuilt_metadata(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"))
    source = table(spark, sf_dir, "supplier")
    rebuilt, lost = J.rebuild_missing(keys, source.where("s_suppkey % 3 = 0"), source, "s_suppkey")
    return Z.union_all([rebuilt.agg(F.count("*").alias("n")).withColumn("part", F.lit("rebuilt")), lost.agg(F.count("*").alias("n")).withColumn("part", F.lit("unmatched"))])


@query("JN12 JN16", "select c_custkey, coalesce(n_name, 'UNKNOWN') as n_name from customer left join (select * from nation where n_regionkey < 3) on c_nationkey = n_nationkey")
def dimension_default(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.with_default(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey").select("c_custkey", "n_name")


# ---------------------------------------------------------------- sets


@query(
    "SET1 T9 DQ8",
    """
select user_id, event_type as last_type, round(value, 6) as last_value, first_event from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r, first_value(event_id) over (partition by user_id order by ts, event_id) as first_event from events) where r = 1""",
)
def last_wins(spark, sf_dir):
    rows = Z.last_wins_rows(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"])
    return rows.select("user_id", F.col("event_type").alias("last_type"), F.round("value", 6).alias("last_value"), F.col("first_place.event_id").alias("first_event"))


@query("SET2 SET4", "select conv_id, string_agg(role, '|' order by role) as roles, count(*) filter (where role in ('user', 'system')) as n_critical from (select distinct conv_id, role from conversations) group by conv_id")
def array_union(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(Z.union_sorted(F.array("role")).alias("roles"))
    critical = F.array_intersect("roles", F.array(F.lit("user"), F.lit("system")))
    return rows.select("conv_id", F.array_join("roles", "|").alias("roles"), F.size(critical).cast("bigint").alias("n_critical"))


@query("SET9 PRJ32 PRJ33 PRJ34", "select 'customer' as domain, count(*) as n, count(segment) as with_segment, case when count(distinct segment) > 5 or avg(length(item)) > 50 then 'open' else 'choice' end as format from (select c_name as item, c_mktsegment as segment from customer) union all select 'supplier', count(*), 0, case when avg(length(s_name)) > 50 then 'open' else 'choice' end from supplier")
def stacked_domains(spark, sf_dir):
    from pairloom.sources.readers import stacked

    frames = {"customer": table(spark, sf_dir, "customer").select("c_name", F.col("c_mktsegment").alias("segment")), "supplier": table(spark, sf_dir, "supplier").select("s_name")}
    both = stacked(frames, {"customer": "c_name", "supplier": "s_name"})
    kind = F.when((F.count_distinct("segment") > 5) | (F.avg(F.length("item_text")) > 50), "open").otherwise("choice")
    return both.groupBy("domain").agg(F.count("*").alias("n"), F.count("segment").alias("with_segment"), kind.alias("format"))


@query("SET11 STR9", "select distinct o_custkey % 97 as idx from orders")
def id_numbers(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.concat(F.lit("q_train_"), (F.col("o_custkey") % 97).cast("string")).alias("id"))
    return Z.id_numbers(ids.union(ids.sparkSession.createDataFrame([("broken_x",)], "id string")), "id")


# ---------------------------------------------------------------- aggregates


@query("AGG1", "select event_type as value, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from events group by 1")
def freq_pct(spark, sf_dir):
    return G.frequency(table(spark, sf_dir, "events"), "event_type").withColumn("pct", F.round("pct", 6))


@query(
    "AGG2 AGG29",
    "select 'o_orderstatus' as field, o_orderstatus as value, count(*) as n from orders group by 2 union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2",
)
def multi_freq(spark, sf_dir):
    return G.frequencies(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


NUMBER = "cast(l_extendedprice as double)"


@query(
    "AGG14 AGG6 AGG12 T12 T13",
    f"""select l_returnflag, l_linestatus, count(*) as n, count({NUMBER}) as n_valid, round(avg({NUMBER}), 4) as mean, round(stddev_pop({NUMBER}), 4) as std, round(quantile_cont({NUMBER}, 0.5), 4) as median, round(quantile_cont({NUMBER}, 0.25), 4) as p25,
  round(quantile_cont({NUMBER}, 0.75), 4) as p75, round(avg(cast({NUMBER} > 0 as integer)), 6) as frac_positive, round(avg(cast({NUMBER} < 0 as integer)), 6) as frac_negative,
  round(list_sort(list({NUMBER}))[count(*) // 2 + 1], 4) as upper_median from lineitem group by 1, 2""",
)
def summary_stats(spark, sf_dir):
    x = F.col("l_extendedprice").cast("double")
    out = G.summary(table(spark, sf_dir, "lineitem").withColumn("x", x), ["l_returnflag", "l_linestatus"], "x", upper=True)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median", "p25", "p75", "upper_median")} | {c: F.round(c, 6) for c in ("frac_positive", "frac_negative")})


@query("AGG7 AGG8 AGG29", "select o_orderpriority, count_if(o_orderstatus = 'F') as f, count_if(o_orderstatus = 'O') as o, count_if(o_orderstatus = 'P') as p from orders group by 1")
def pivot_coverage(spark, sf_dir):
    c = G.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return c.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


MAJORITY = """
v as (select l_orderkey, l_returnflag as value, count(*) as c, min(l_linenumber) as seen from lineitem group by 1, 2),
t as (select *, row_number() over (partition by l_orderkey order by c desc, seen, value) as r, sum(c) over (partition by l_orderkey) as n, count(*) over (partition by l_orderkey) as u from v)"""


@query("AGG10 T11", f"with {MAJORITY} select l_orderkey, round(c / n, 6) as majority_frac, u = 1 as unanimous, u as n_unique, c as votes from t where r = 1")
def majority_vote(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    voted = G.majority(lines, ["l_orderkey"], "l_returnflag", "l_linenumber")
    n = lines.groupBy("l_orderkey").agg(F.count("l_returnflag").alias("n"))
    return voted.join(n, "l_orderkey").select("l_orderkey", F.round("majority_frac", 6).alias("majority_frac"), "unanimous", "n_unique", F.round(F.col("majority_frac") * F.col("n")).cast("bigint").alias("votes"))


@query(
    "AGG11 DQ12",
    "with o as (select l_orderkey, count(distinct l_returnflag) = 1 as flag, count(distinct l_linestatus) = 1 as status from lineitem group by 1) select 'flag' as field, round(avg(cast(flag as integer)), 6) as rate from o union all select 'status', round(avg(cast(status as integer)), 6) from o",
)
def agreement_rates(spark, sf_dir):
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.count_distinct("l_returnflag") == 1).alias("flag"), (F.count_distinct("l_linestatus") == 1).alias("status"))
    return G.agreement(o, ["flag", "status"]).withColumn("rate", F.round("rate", 6))


@query("AGG28 AGG35", "select source, count(*) as n, count(distinct lang) as n_langs, round(avg(length(text)), 6) as mean_length, min(lang) as first_lang, count(text) as n_text from documents group by source")
def described_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("n_langs"), F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.min("lang").alias("first_lang"), F.count("text").alias("n_text"))


@query("AGG35", "select 'c_name' as field, count(c_name) as n_present from customer union all select 'rich', count(case when c_acctbal > 0 then 1 end) from customer")
def field_presence(spark, sf_dir):
    return G.presence(table(spark, sf_dir, "customer").select("c_name", F.when(F.col("c_acctbal") > 0, 1).alias("rich")), ["c_name", "rich"])


@query(
    "AGG32 AGG33 FLT6 DQ12",
    "select * from (select p_brand, count(*) as n, case when count_if(p_type = 'STANDARD') > 0 then count_if(p_type = 'STANDARD') else count_if(contains(lower(p_type), 'standard')) end as n_standard, count_if(p_size > 40) as n_large from part group by 1) where n >= 10",
)
def label_balance(spark, sf_dir):
    exact, near = F.count_if(F.col("p_type") == "STANDARD"), F.count_if(F.lower("p_type").contains("standard"))
    out = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.when(exact > 0, exact).otherwise(near).alias("n_standard"), F.count_if(F.col("p_size") > 40).alias("n_large"))
    return out.where("n >= 10")


@query("FLT5 ST8 AGG9", "select lang, round(avg(toxic) filter (where quality = 1), 6) as toxic_if_good, round(avg(toxic), 6) as toxic_rate, case when stddev_pop(toxic) > 0 then round(corr(cast(toxic as double), cast(length(text) as double)), 6) end as length_corr from documents join labels using (doc_id) group by lang")
def conditional_rates(spark, sf_dir):
    from pairloom.plans.statistics import point_biserial

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.round(F.avg(F.when(F.col("quality") == 1, F.col("toxic"))), 6).alias("toxic_if_good"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.round(point_biserial(F.col("toxic"), F.length("text").cast("double")), 6).alias("length_corr"))


# ---------------------------------------------------------------- windows


@query(
    "WIN3 WIN11 SRT1 SRT4 SRT5",
    "select o_orderpriority, o_orderkey, round(o_totalprice, 4) as o_totalprice, r as rank from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders) where r <= 5",
)
def top_per_group(spark, sf_dir):
    top = W.top_k(table(spark, sf_dir, "orders"), ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 5)
    return top.select("o_orderpriority", "o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "WIN6 WIN13",
    "select conv_id, turn, cast(len(list(role) over w) as bigint) as prefix, array_to_string(list(role) over w, ',') as roles, cast(sum(length(text)) over w as bigint) as cumulative from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and current row)",
)
def prefix_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))
    out = W.cumulative(W.prefixes(rows, ["conv_id"], "turn", "role"), ["conv_id"], "turn", "n")
    return out.select("conv_id", "turn", F.size("prefix").cast("bigint").alias("prefix"), F.array_join("prefix", ",").alias("roles"), "cumulative")


@query("WIN8 SRT7", "select conv_id, min_by(text, turn) filter (where role = 'assistant') as first_answer from conversations group by conv_id")
def first_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("answer", F.when(F.col("role") == "assistant", F.col("text")))
    return rows.groupBy("conv_id").agg(W.first_present(F.col("answer"), F.col("turn")).alias("first_answer"))


@query(
    "WIN9",
    """with c as (select p_brand, p_type, count(*) as n from part group by 1, 2 having count(*) >= 5), r as (select *, row_number() over (partition by p_brand order by n desc, p_type) as r from c), f as (select * from r where r <= 4),
p as (select a.p_brand, a.p_type as a, b.p_type as b, a.n as na, b.n as nb, row_number() over (partition by a.p_brand order by a.r, b.r) as pair_rank from f a join f b on a.p_brand = b.p_brand and a.r < b.r)
select * from p where pair_rank <= 3""",
)
def label_pairs(spark, sf_dir):
    return W.label_pairs(table(spark, sf_dir, "part"), "p_brand", "p_type", 5, 3).withColumn("pair_rank", F.col("pair_rank").cast("bigint"))


@query(
    "WIN10 T15",
    """with e as (select quantile_cont(cast(l_quantity as double), [0, 0.2, 0.4, 0.6, 0.8, 1.0]) as e from lineitem), b as (select i - 1 as bin, e[i] as low, e[i + 1] as high from e, (select unnest([1, 2, 3, 4, 5]) as i))
select cast(bin as integer) as bin, count(*) as n, round(avg(l_quantity), 6) as mean, round(avg(cast(l_returnflag = 'R' as integer)), 6) as rate from lineitem join b on l_quantity >= low - 1e-10 and l_quantity <= high + 1e-10 group by bin""",
)
def bin_rates(spark, sf_dir):
    out = W.percentile_bins(table(spark, sf_dir, "lineitem"), "l_quantity", 5, {"mean": F.col("l_quantity"), "rate": (F.col("l_returnflag") == "R").cast("int")})
    return out.withColumns({"mean": F.round("mean", 6), "rate": F.round("rate", 6)})


# ---------------------------------------------------------------- samples


@query("SMP1", "select c_custkey from customer order by md5(cast(c_custkey as varchar) || ':42'), c_custkey limit 200")
def seeded_sample(spark, sf_dir):
    return S.sample(table(spark, sf_dir, "customer"), "c_custkey", 200).select("c_custkey")


@query("SMP2", "select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by md5(cast(c_custkey as varchar) || ':42'), c_custkey) as r from customer) where r <= 20")
def stratified_sample(spark, sf_dir):
    return S.stratified(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 20).select("c_mktsegment", "c_custkey")


@query(
    "SMP5 SMP7",
    """with n as (select event_type, count(*) as n from events group by 1), r as (select *, row_number() over (partition by event_type order by md5(cast(event_id as varchar) || ':42'), event_id) as r from events)
select event_type, count(*) as n, cast(sum(event_id) as bigint) as id_sum from r where r <= (select min(n) from n) group by 1""",
)
def equalise_groups(spark, sf_dir):
    return S.equalised(table(spark, sf_dir, "events"), "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("id_sum"))


@query(
    "SMP3 SMP11",
    """select 'urgent' as task, count(*) as n from orders where o_orderpriority = '1-URGENT' union all select 'pending', count(*) from orders where o_orderstatus = 'P'
union all select 'injected', count(*) from (select 1 from orders where o_orderstatus = 'F' limit (select count(*) from orders where o_orderstatus = 'P'))""",
)
def balanced_plan(spark, sf_dir):
    plan = S.balanced_plan(table(spark, sf_dir, "orders"), "o_orderkey", {"urgent": F.col("o_orderpriority") == "1-URGENT", "pending": F.col("o_orderstatus") == "P"}, F.col("o_orderstatus") == "F", "pending")
    return plan.groupBy("task").agg(F.count("*").alias("n"))


@query("SMP8", "select cast(null as varchar) as issue")
def split_check(spark, sf_dir):
    return S.split_issue(S.group_split(table(spark, sf_dir, "customer"), "c_custkey", 0.3), "c_mktsegment")

"""Queries over text: the audit and the string operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import text as X
from pairloom.operators import registry as R
from pairloom.operators.aggregates import co_occurrence, element_frequency, rate
from pairloom.operators.sampling import bucket_plan, group_split
from pairloom.plans.registry import query
from pairloom.session import spread, table

# RE2 knows word boundaries of ASCII only; other letters stand as x there
LOW = "regexp_replace(lower(text), '[^\\x00-\\x7F]', 'x', 'g')"


def _rates_sql() -> str:
    flags = ",\n  ".join(f"round(avg(cast(regexp_matches({LOW}, '{p}') as integer)), 6) as has_{n}" for n, p in R.PROSE_PATTERNS.items())
    return f"select lang, count(*) as n, {flags} from documents group by lang"


@query("SRC7 STR1 AGG4 AGG9", _rates_sql())
def audit_rates(spark, sf_dir):
    low = F.lower("text")
    flags = [F.round(rate(low.rlike(p)), 6).alias(f"has_{n}") for n, p in R.PROSE_PATTERNS.items()]
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), *flags)


ASCII_PATTERNS = {c: {k: v for k, v in p.items() if v.isascii()} for c, p in R.AUDIT_PATTERNS.items()}


def _labels_sql() -> str:
    parts = [f"select '{c}' as category, '{n}' as label, count(*) as n from documents where regexp_matches({LOW}, '{p.replace(chr(39), chr(39) * 2)}')" for c, ps in ASCII_PATTERNS.items() for n, p in ps.items()]
    return "select * from (" + " union all ".join(parts) + ") where n > 0"


@query("STR1 AGG3 T16", _labels_sql())
def audit_labels(spark, sf_dir):
    some = lambda p: F.when(F.col("low").rlike(X.any_of(list(p.values()))), X.tags(F.col("low"), p, lowered=True)).otherwise(F.array().cast("array<string>"))
    every = F.flatten(F.array(*[F.transform(some(p), _pair(c)) for c, p in ASCII_PATTERNS.items()]))
    hit = F.col("low").rlike(X.any_of([p for ps in ASCII_PATTERNS.values() for p in ps.values()]))
    return spread(table(spark, sf_dir, "documents").select("text")).select(F.lower("text").alias("low")).where(hit).select(F.explode(every).alias("e")).groupBy("e.category", "e.label").agg(F.count("*").alias("n"))


def _pair(category):
    return lambda x: F.struct(F.lit(category).alias("category"), x.alias("label"))


FLAGS = ["the", "of", "que", "der", "digit"]


def _cooccurrence_sql() -> str:
    total = " + ".join(f"cast(regexp_matches({LOW}, '{R.PROSE_PATTERNS[f]}') as integer)" for f in FLAGS)
    return f"select cast({total} as bigint) as n_flags, count(*) as n from documents group by 1"


@query("AGG5", _cooccurrence_sql())
def audit_cooccurrence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*[F.lower("text").rlike(R.PROSE_PATTERNS[f]).alias(f) for f in FLAGS])
    return co_occurrence(docs, FLAGS).select(F.col("n_flags").cast("bigint").alias("n_flags"), "n")


AGE_TEXT = "'A ' || cast(p_size as varchar) || '-year-old with a ' || cast(p_partkey % 20 as varchar) || ' month old'"


@query(
    "STR2",
    f"""
with t as (select p_partkey, {AGE_TEXT} as text, cast(p_size as double) as a, cast(p_partkey % 20 as double) / 12 as b from part)
select p_partkey, round(a, 6) as first_age, round(b, 6) as second_age,
  case when a < 1 then 'infant' when a < 13 then 'child' when a < 18 then 'adolescent' when a < 30 then 'young_adult'
    when a < 50 then 'middle_aged' when a < 65 then 'older_adult' else 'elderly' end as age_group
from t""",
)
def age_extract(spark, sf_dir):
    text = F.concat(F.lit("A "), F.col("p_size").cast("string"), F.lit("-year-old with a "), (F.col("p_partkey") % 20).cast("string"), F.lit(" month old"))
    parts = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    found = parts.select("p_partkey", X.ages(F.col("text")).alias("ages"), X.age_group(F.col("text")).alias("age_group"))
    return found.select("p_partkey", F.round(F.get("ages", F.lit(0)), 6).alias("first_age"), F.round(F.get("ages", F.lit(1)), 6).alias("second_age"), "age_group")


def _detect_sql() -> str:
    either = lambda ps: " or ".join(f"regexp_matches({LOW}, '{p}')" for p in ps)
    flags = ", ".join(f"count(*) filter (where {either(ps)}) as {n}" for n, ps in R.DETECT.items())
    return f"select lang, {flags} from documents group by lang"


@query("STR3", _detect_sql())
def detect_flags(spark, sf_dir):
    low = F.lower("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.count_if(low.rlike(X.any_of(ps))).alias(n) for n, ps in R.DETECT.items()])


@query(
    "STR4 STR5",
    """
select p_partkey,
  trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_type || '/' || p_brand || ' #1')), '[/ ]', '_', 'g'), '[^a-z0-9_]+', '', 'g'), '_+', '_', 'g'), '_') as slug,
  trim(regexp_replace(regexp_replace(lower(p_name || '-' || p_brand || '_x'), '[''"_-]', ' ', 'g'), '\\s+', ' ', 'g')) as folded
from part""",
)
def slug_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", X.slug(F.concat("p_type", F.lit("/"), "p_brand", F.lit(" #1"))).alias("slug"), X.folded_label(F.concat("p_name", F.lit("-"), "p_brand", F.lit("_x"))).alias("folded"))


@query(
    "STR15 SMP8",
    """
select c_mktsegment, count(*) as n, count(*) filter (where is_test) as n_test, cast(sum(bucket) as bigint) as bucket_sum from (
  select c_mktsegment, cast('0x' || substr(md5(cast(c_nationkey as varchar) || ':42'), 1, 8) as bigint) / 4294967296.0 < 0.3 as is_test,
    cast('0x' || substr(md5(cast(c_custkey as varchar) || '_' || c_mktsegment), 25, 8) as bigint) % 1024 as bucket
  from customer) group by 1""",
)
def md5_group_split(spark, sf_dir):
    split = group_split(table(spark, sf_dir, "customer"), "c_nationkey", 0.3)
    bucket = X.hash_group(F.col("c_custkey").cast("string"), F.col("c_mktsegment"), modulus=1024)
    return split.withColumn("bucket", bucket).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"), F.sum("bucket").alias("bucket_sum"))


@query(
    "STR10 STR18 AGG6",
    "select source, count(*) as n, round(avg(length(text)), 6) as mean_length, cast(min(length(text)) as bigint) as least, cast(max(length(text)) as bigint) as most, round(median(length(text)), 6) as median_length, cast(sum(length(substr(text, 1, 200))) as bigint) as preview_chars from documents group by source",
)
def text_lengths(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_length"), F.min(n).cast("bigint").alias("least"), F.max(n).cast("bigint").alias("most"),
        F.round(F.median(n), 6).alias("median_length"), F.sum(F.length(X.preview(F.col("text")))).alias("preview_chars"),
    )


CHOICES = "'Q' || cast(s_suppkey as varchar) || chr(10) || 'Answer choices:' || chr(10) || 'A. x' || chr(10) || 'B. y'"


@query(
    "STR6 STR7 STR14 STR16",
    f"""
select s_suppkey, 'Q' || cast(s_suppkey as varchar) as stripped,
  'A ' || cast(s_suppkey as varchar) || '-year-old boy whose family is currently unhoused' as rewritten,
  '{{"a": ' || cast(s_suppkey as varchar) || '}}' as unfenced, contains(lower(s_name), '00') as has_zeros
from supplier""",
)
def text_cleaning(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        X.strip_choices(F.concat(F.lit("Q"), key, F.lit("\nAnswer choices:\nA. x\nB. y"))).alias("stripped"),
        X.first_rewrite(F.concat(F.lit("A currently unhoused "), key, F.lit("-year-old boy"))).alias("rewritten"),
        X.without_fences(F.concat(F.lit('```json\n{"a": '), key, F.lit("}\n```"))).alias("unfenced"),
        X.contains_any_case(F.col("s_name"), F.lit("00")).alias("has_zeros"),
    )


def _nonclinical_sql() -> str:
    hits = lambda ps: " + ".join(f"cast(regexp_matches({LOW}, '{p}') as integer)" for p in ps)
    anatomy = "|".join(R.ANATOMY_WORDS)
    return f"select lang, count(*) filter (where {hits(R.STATISTICS_WORDS)} >= 2 and {hits(R.CLINICAL_WORDS)} = 0) as nonclinical, count(*) filter (where regexp_matches({LOW}, '{anatomy}')) as anatomy, count(*) as n from documents group by lang"


@query("FLT9 STR17", _nonclinical_sql())
def clinical_filters(spark, sf_dir):
    empty = F.array().cast("array<string>")
    return spread(table(spark, sf_dir, "documents").select("lang", "text")).groupBy("lang").agg(
        F.count_if(X.nonclinical(F.col("text"), R.STATISTICS_WORDS, R.CLINICAL_WORDS)).alias("nonclinical"),
        F.count_if(X.anatomy_sensitive(empty, F.col("text"), R.ANATOMY_WORDS)).alias("anatomy"),
        F.count("*").alias("n"),
    )


@query(
    "SMP4 AGG3",
    f"""
select bucket, count(*) as n from (
  select 'article' as bucket from documents where regexp_matches({LOW}, '\\bthe\\b')
  union all select 'digit' from documents where regexp_matches({LOW}, '[0-9]')
  union all select 'long' from documents where length(text) > 2000) group by 1""",
)
def text_buckets(spark, sf_dir):
    low = F.lower("text")
    plan = bucket_plan(table(spark, sf_dir, "documents"), {"article": low.rlike(r"\bthe\b"), "digit": low.rlike("[0-9]"), "long": F.length("text") > 2000})
    return plan.groupBy("bucket").agg(F.count("*").alias("n"))


@query(
    "STR8 STR9 SET11",
    """
select conv_id, string_agg(role, '|' order by turn) as roles, cast(count(distinct turn) as bigint) as n_turns,
  cast(max(turn) as bigint) as last_turn from conversations group by conv_id""",
)
def joined_roles(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").withColumn("id", F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
    turn = F.expr("try_cast(substring_index(id, '_', -1) as bigint)")
    rows = ids.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"), F.count_distinct(turn).alias("n_turns"), F.max(turn).alias("last_turn"))
    return rows.select("conv_id", X.joined(F.transform("r", lambda x: x["role"])).alias("roles"), "n_turns", "last_turn")


@query("AGG3", "select w as element, count(*) as n from (select unnest(string_split(p_type, ' ')) as w from part) group by 1")
def word_frequency(spark, sf_dir):
    return element_frequency(table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("w")), "w")


@query("STR11 STR12 STR13 AGG34 DQ5")
def edit_ratios(spark, sf_dir):
    """Benchmark items against themselves with some words replaced."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text", F.regexp_replace("text", r"\bthe\b", "one").alias("edited"))
    found = items.withColumns({"ratio": X.edit_ratio(F.col("text"), F.col("edited")), "regions": X.edit_regions(F.col("text"), F.col("edited")), "diff": X.line_diff(F.col("text"), F.col("edited"))})
    return found.select("item_id", F.round("ratio", 6).alias("edit_ratio"), F.size("regions").alias("n_regions"), (F.col("ratio") > 0.35).alias("high_edit"), F.length("diff").alias("diff_chars"))

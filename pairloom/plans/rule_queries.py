"""Queries over rule engines, nested records and validation. ``lineitem`` and ``part`` rows carry
synthetic annotations, made from their keys by the same arithmetic on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairloom.functions import arrays as A
from pairloom.operators import nested, quality, rules
from pairloom.operators import registry as R
from pairloom.plans.registry import query
from pairloom.session import table


def _pick(values: list, key, sql: bool):
    if sql:
        quoted = ", ".join("null" if v is None else f"'{v}'" for v in values)
        return f"([{quoted}])[cast(({key}) % {len(values)} as integer) + 1]"
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))


VALIDITY, COHERENCE = R.ENUMS_LEGACY["counterfactual_validity"], R.ENUMS_LEGACY["clinical_coherence"]
ROLES = [*R.ENUMS_LEGACY["target_attribute_role"], "ambiguous", None]
INVARIANCE = R.ENUMS_LEGACY["gold_answer_invariance"]
REASONS = [None, "Identical to the original", "not possible"]


def annotated(spark, sf_dir):
    """Every part with a text (or none), a reason, validity, coherence, role, relevance, invariance."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey", "p_size", F.when(k % 4 != 0, "text").alias("text"), _pick(REASONS, F.floor(k / 4), False).alias("reason"), _pick(VALIDITY, k, False).alias("validity"),
        _pick(COHERENCE, F.floor(k / 3), False).alias("coherence"), _pick(ROLES, F.floor(k / 9), False).alias("role"), _pick(ROLES, F.floor(k / 63), False).alias("relevance"), _pick(INVARIANCE, F.floor(k / 5), False).alias("invariance"),
    )


ANNOTATED = f"""a as (select p_partkey, p_size, case when p_partkey % 4 <> 0 then 'text' end as text, {_pick(REASONS, 'p_partkey // 4', True)} as reason, {_pick(VALIDITY, 'p_partkey', True)} as validity,
  {_pick(COHERENCE, 'p_partkey // 3', True)} as coherence, {_pick(ROLES, 'p_partkey // 9', True)} as role, {_pick(ROLES, 'p_partkey // 63', True)} as relevance, {_pick(INVARIANCE, 'p_partkey // 5', True)} as invariance from part)"""
_GOOD = "validity = 'valid' and coherence = 'preserved' and invariance in ('invariant', 'likely_invariant')"
_MID = "validity in ('valid', 'questionable') and coherence in ('preserved', 'weakened')"
_BAD = "validity = 'invalid' or coherence = 'broken'"
_SAME = "text is null and contains(lower(coalesce(reason, '')), 'identical')"


def _class_sql(null: str, first: str, role: str, second: str, last: str, extra: str = "") -> str:
    return f"case when {_SAME} then 'identical' when text is null then '{null}' when {_GOOD} and {role} in ({first}) then 'class1' when {_MID} and {role} in ({second}) then 'class2' when {_BAD}{extra} then 'class3' {last} end"


@query(
    "PRJ4 PRJ5 PRJ6 PRJ7 PRJ8 T1 T3",
    f"""with {ANNOTATED} select p_partkey,
  {_class_sql('class3', "'irrelevant'", 'relevance', "'epidemiologic', 'mechanistically_causal'", '')} as summary,
  {_class_sql('class3', "'irrelevant', 'socially_loaded'", 'role', "'epidemiologic', 'mechanistically_causal'", "else 'unclassified'", " or role = 'sex_specific'")} as validator,
  {_class_sql('excluded', "'irrelevant', 'socially_loaded'", 'coalesce(role, relevance)', "'epidemiologic', 'mechanistically_causal', 'ambiguous'", "else 'class2'")} as extract,
  {_class_sql('excluded', "'irrelevant', 'socially_loaded'", 'role', "'epidemiologic', 'mechanistically_causal'", "else 'class2'")} as trace from a""",
)
def class_rules(spark, sf_dir):
    c = {n: F.col(n) for n in ("text", "reason", "validity", "coherence", "role", "relevance", "invariance")}
    head = (c["text"], c["reason"], c["validity"], c["coherence"])
    return annotated(spark, sf_dir).select(
        "p_partkey",
        rules.class_summary(*head, c["relevance"], c["invariance"]).alias("summary"),
        rules.class_validator(*head, c["role"], c["invariance"]).alias("validator"),
        rules.class_extract(*head, c["role"], c["relevance"], c["invariance"]).alias("extract"),
        rules.class_trace(*head, c["role"], c["invariance"]).alias("trace"),
    )


KINDS = [i[0] for i in R.INTERVENTIONS] + ["gender", "race", "housing", "honorific", "something", ""]
SCOPES, STRENGTHS = [*R.ENUMS_STRICT["edit_scope"], None], [*R.ENUMS_FLAT["edit_strength"], None]
BUCKETS = [*R.BUCKETS, None, "odd"]
CLASSES = ["class1", "control", None, "class3"]


def typed(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        "p_partkey", _pick(KINDS, k, False).alias("intervention_type"), _pick(BUCKETS, F.floor(k / 2), False).alias("analysis_bucket"), _pick(CLASSES, F.floor(k / 7), False).alias("analysis_class"),
        _pick(["neutral_rework", None, "other"], F.floor(k / 11), False).alias("control_subtype"), _pick(SCOPES, F.floor(k / 3), False).alias("edit_scope"), _pick(STRENGTHS, F.floor(k / 5), False).alias("edit_strength"),
        _pick(["minimal", None, "multi_sentence"], F.floor(k / 13), False).alias("edit_locality"), F.col("p_size").alias("n_tokens_changed"), F.col("p_type").alias("label"),
    )


TYPED = f"""t as (select p_partkey, {_pick(KINDS, 'p_partkey', True)} as kind, {_pick(BUCKETS, 'p_partkey // 2', True)} as bucket, {_pick(CLASSES, 'p_partkey // 7', True)} as cls, {_pick(['neutral_rework', None, 'other'], 'p_partkey // 11', True)} as sub,
  {_pick(SCOPES, 'p_partkey // 3', True)} as scope, {_pick(STRENGTHS, 'p_partkey // 5', True)} as strength, {_pick(['minimal', None, 'multi_sentence'], 'p_partkey // 13', True)} as loc, p_size as changed, p_type as label from part)"""


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@query(
    "PRJ9 PRJ10 PRJ11 PRJ13 PRJ14 PRJ15 PRJ16 T2",
    f"""with {TYPED}, n as (select *, case when kind = '' then 'unknown' when kind = 'gender' then 'sex' when kind = 'race' then 'race_ethnicity' else kind end as k from t)
select p_partkey, k as normalized_attribute,
  case when bucket in {_in(R.BUCKETS)} then bucket when cls = 'control' or k in {_in(R.CONTROLS)} then 'control'
    when cls in ('class1', 'class2', 'class3') then case when k in {_in(R.STRUCTURAL_TYPES)} then 'structural_context' when k in {_in(R.IDENTITY_TYPES)} then 'identity_bias' else 'core_bias' end
    when k in {_in(R.STRUCTURAL_TYPES)} then 'structural_context' when k in {_in(R.IDENTITY_TYPES)} then 'identity_bias' when k in {_in(R.CORE_TYPES)} then 'core_bias' when sub in {_in(R.CONTROLS)} then 'control' else 'other' end as normalized_group,
  case when sub in {_in(R.CONTROLS)} then sub when k in {_in(R.CONTROLS)} then k end as normalized_control_subtype,
  case when loc in ('minimal', 'sentence_level', 'broader', 'single') then loc when strength = 'minimal' then 'minimal'
    when strength = 'single' and scope = 'sentence' then 'sentence_level' when strength = 'single' and scope = 'multi_sentence' then 'broader' when strength = 'single' and scope in ('token', 'phrase') then 'single'
    when scope = 'sentence' then 'sentence_level' when scope = 'multi_sentence' then 'broader' when scope in ('token', 'phrase') then 'minimal'
    when changed <= 3 then 'minimal' when changed <= 12 then 'single' else 'broader' end as normalized_edit_locality, label as normalized_label from n""",
)
def normalized_metadata(spark, sf_dir):
    out = rules.with_normalized(typed(spark, sf_dir))
    return out.select("p_partkey", *[c for c in out.columns if c.startswith("normalized_")])


@query(
    "PRJ12 PRJ13 PRJ14 PRJ17",
    f"""with {TYPED}, n as (select *, case kind when 'gender' then 'sex' when 'race' then 'race_ethnicity' when 'housing' then 'housing_status' else kind end as k from t)
select p_partkey, case when cls = 'control' or k in {_in([*R.CONTROLS, 'control'])} then 'control' when bucket in {_in(R.BUCKETS)} then bucket when k in {_in(R.CORE_TYPES)} then 'core_bias' when k in {_in(R.IDENTITY_TYPES)} then 'identity_bias'
    when k in {_in(R.STRUCTURAL_TYPES)} then 'structural_context' else 'unknown' end as grp,
  coalesce(case when sub in {_in(R.CONTROLS)} then sub end, case when kind in {_in(R.CONTROLS)} then kind end, 'none') as subtype,
  coalesce(loc, strength, scope) as locality, case k {' '.join(f"when '{a}' then '{b}'" for a, b in R.DISPLAY.items())} else k end as shown from n""",
)
def extraction_groups(spark, sf_dir):
    t, kind = typed(spark, sf_dir), F.col("intervention_type")
    return t.select(
        "p_partkey",
        rules.group_extraction(kind, F.col("analysis_bucket"), F.col("analysis_class")).alias("grp"),
        rules.control_subtype_extraction(kind, F.col("control_subtype")).alias("subtype"),
        rules.locality_extraction(F.col("edit_locality"), F.col("edit_strength"), F.col("edit_scope")).alias("locality"),
        rules.display_type(kind).alias("shown"),
    )


LABELS = ["Male", "non-binary person", "Trans woman", "gender non-conforming", "same-sex partner", "Gay man", "other", None]
FAMILY_KINDS = ["sex", "sex_gender", "race_ethnicity", "omit_race", "sexual_orientation", "gender_identity", "neutral_rework", "age"]


def _family_sql(test: str) -> str:
    return f"case when k in {_in(R.CONTROLS)} then 'control' when k in ('race_ethnicity', 'omit_race') then 'race' when k in ('sexual_orientation', 'gender_identity') then k when k in ('sex', 'sex_gender') then case when {test} then 'gender_identity' else 'sex_gender' end end"


def _contains_sql(column: str, parts: list[str]) -> str:
    return "(" + " or ".join(f"contains(coalesce({column}, ''), '{p}')" for p in parts) + ")"


@query(
    "PRJ18 PRJ19 T4",
    f"""with f as (select p_partkey, {_pick(FAMILY_KINDS, 'p_partkey', True)} as k, {_pick(LABELS, 'p_partkey // 8', True)} as l from part), g as (select *, trim(regexp_replace(regexp_replace(lower(coalesce(l, '')), '[''"_-]', ' ', 'g'), '\\s+', ' ', 'g')) as n from f)
select p_partkey, {_family_sql(_contains_sql('n', R.GENDER_IDENTITY_FRAGMENTS))} as late_family, {_family_sql(_contains_sql('lower(l)', R.GENDER_IDENTITY_LABELS))} as head_family,
  case when {_contains_sql('n', R.PARTNER_FRAGMENTS)} then 'partner' when {_contains_sql('n', R.EXPLICIT_FRAGMENTS)} then 'explicit' else 'other' end as orientation from g""",
)
def families(spark, sf_dir):
    from pairloom.functions.text import folded_label

    k = F.col("p_partkey")
    f = table(spark, sf_dir, "part").select("p_partkey", _pick(FAMILY_KINDS, k, False).alias("k"), _pick(LABELS, F.floor(k / 8), False).alias("l"))
    return f.select("p_partkey", rules.family_late(F.col("k"), F.col("l")).alias("late_family"), rules.family_heads(F.col("k"), F.col("l"), F.lit(None).cast("string")).alias("head_family"), rules.orientation_split(folded_label(F.col("l"))).alias("orientation"))


REG_SQL = "reg(kind, family, sem, bucket, ladder, tier) as (values " + ", ".join(f"('{a}', '{b}', '{c}', '{d}', {str(e).lower()}, '{f}')" for a, b, c, d, e, f in R.INTERVENTIONS) + ")"


@query(
    "PRJ20 PRJ21 PRJ37 JN12 VEC27",
    f"""with {REG_SQL}, s as (select p_partkey, {_pick(KINDS, 'p_partkey', True)} as kind, {_pick(STRENGTHS, 'p_partkey // 5', True)} as strength, {_pick(['low', 'moderate', 'high', None], 'p_partkey // 3', True)} as sal, cast(p_size as double) / 50 as conf, p_partkey % 6 = 0 as empty from part)
select p_partkey, coalesce(family, 'UNKNOWN') as intervention_family, coalesce(bucket, 'UNKNOWN') as analysis_bucket,
  case when family is not null and (kind.k in {_in(R.CONTROLS)} or (not ladder and coalesce(strength, 'single') in ('minimal', 'moderate', 'strong'))) then 'single' else coalesce(strength, 'single') end as edit_strength,
  case when family is null then sal when kind.k in {_in(R.CONTROLS)} then 'low' when kind.k in {_in(list(R.SALIENCE_FLOOR))} then case when sal = 'high' then 'high' else 'moderate' end else sal end as social_bias_salience,
  case when family is null then conf else round(least(conf, case when kind.k in {_in(R.CONTROLS)} then 1.0 when empty then 0.98 when kind.k in ('gender_identity', 'sexual_orientation', 'insurance_status', 'housing_status') then 0.9 when kind.k in ('race_ethnicity', 'name', 'pronoun') then 0.95 else conf end), 3) end as annotation_confidence
from (select *, kind as k from s) kind left join reg on kind.k = reg.kind""",
)
def static_fields(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", _pick(KINDS, k, False).alias("intervention_type"), _pick(STRENGTHS, F.floor(k / 5), False).alias("edit_strength"), _pick(["low", "moderate", "high", None], F.floor(k / 3), False).alias("social_bias_salience"),
        (F.col("p_size").cast("double") / 50).alias("annotation_confidence"), F.when(k % 6 != 0, "t").alias("text"), F.lit("x").alias("identity_explicitness"), F.lit("y").alias("medical_relevance"), F.col("p_type").alias("attribute_value_counterfactual"),
    )
    out = rules.attach_static(rows, R.intervention_registry(spark))
    return out.select("p_partkey", "intervention_family", "analysis_bucket", "edit_strength", "social_bias_salience", "annotation_confidence")


TIER_FLAGS = ["conflicting"]


@query(
    "DQ6 AGG10 AGG11 SET2 WIN8",
    f"""with p as (select l_orderkey as k, l_linenumber as o, l_partkey as i, {_pick(VALIDITY, 'l_orderkey // 3', True)} as validity, {_pick(COHERENCE, 'l_orderkey // 9', True)} as coherence, {_pick(ROLES[:5], 'l_orderkey + l_linenumber // 4', True)} as role, {_pick(INVARIANCE, 'l_orderkey // 7', True)} as invariance,
  l_quantity / 50.0 as conf, case when l_orderkey % 11 <> 0 then 't' end as text from lineitem),
u as (select distinct k, o, validity, coherence, role, invariance, text, 0 as z from p),
r as (select k, role, count(*) as c, min(o) as seen from p where role is not null group by 1, 2), rm as (select *, row_number() over (partition by k order by c desc, seen) as x, sum(c) over (partition by k) as n, count(*) over (partition by k) as nu from r),
m as (select k, avg(conf) as conf, any_value(validity) as v, any_value(coherence) as co, any_value(invariance) as inv, any_value(text) as text from p group by k),
j as (select m.*, rm.role, rm.c / rm.n as frac, rm.nu = 1 as unan from m join rm on m.k = rm.k and rm.x = 1)
select k as l_orderkey, case when text is null then 'tier3' when v = 'invalid' or co = 'broken' then 'tier3'
  when unan and conf >= 0.8 and v = 'valid' and co = 'preserved' and role in ('irrelevant', 'socially_loaded') and inv in ('invariant', 'likely_invariant') then 'tier1'
  when unan and conf >= 0.8 and v = 'valid' and co = 'preserved' and role in ('epidemiologic', 'mechanistically_causal') then 'tier1_medical'
  when frac >= 0.5 and v in ('valid', 'questionable') and conf >= 0.5 then 'tier2' when conf < 0.5 then 'tier3' else 'tier2' end as tier, round(conf, 6) as mean_confidence from j""",
)
def tiering(spark, sf_dir):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    passes = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", _pick(VALIDITY, F.floor(k / 3), False).alias("counterfactual_validity"), _pick(COHERENCE, F.floor(k / 9), False).alias("clinical_coherence"),
        _pick(ROLES[:5], k + F.floor(n / 4), False).alias("target_attribute_role"), _pick(INVARIANCE, F.floor(k / 7), False).alias("gold_answer_invariance"), (F.col("l_quantity") / 50.0).alias("annotation_confidence"),
        F.when(k % 11 != 0, "t").alias("text"), F.lit(None).cast("string").alias("reason_if_null"), F.array().cast("array<string>").alias("uncertainty_flags"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("row"),  # an order has line numbers twice
    )
    out = quality.reconcile(passes, ["l_orderkey"], "l_linenumber", TIER_FLAGS, "row")
    return out.select("l_orderkey", "tier", F.round("mean_confidence", 6).alias("mean_confidence"))


@query(
    "DQ2 DQ3 DQ7 FLT3 FLT15",
    f"""with {TYPED} select 'analysis_bucket' as field, count(*) as n from t where bucket is not null and bucket not in {_in(R.BUCKETS)} union all select 'intervention_type', count(*) from t where kind not in {_in(R.ENUMS_FLAT['intervention_type'])}""",
)
def enum_issues(spark, sf_dir):
    enums = {f: R.ENUMS_FLAT[f] for f in ("analysis_bucket", "intervention_type", "edit_strength")}
    return quality.enum_issues(typed(spark, sf_dir), ["p_partkey"], enums).groupBy("field").agg(F.count("*").alias("n"))


@query("ARR3 SET10 AGG33", "select category, label, count(*) as n_missing from (select c_custkey from customer) cross join (values " + ", ".join(f"('{c}', '{v}')" for c, vs in R.EXPECTED_GRID.items() for v in vs) + ") g(category, label) where not (c_custkey % 13 = length(label)) group by 1, 2")
def missing_grid(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question_id"))
    grid = nested.expected_grid(spark)
    have = ids.crossJoin(F.broadcast(grid)).where(F.col("question_id") % 13 == F.length("label"))  # 13 rows of constants
    out = nested.grid_lookup(ids, have, spark)
    return out.where(~F.col("present")).groupBy("category", "label").agg(F.count("*").alias("n_missing"))


@query("ARR2 FLT1", "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as k_sum, count_if(contains(props, '[')) as n_lists from events group by event_type")
def json_extract(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.count_if(F.left(F.ltrim("props"), F.lit(1)) == "[").alias("n_lists"))


@query("PRJ1 PRJ4 FLT2", "select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as integer) as position, role as intervention_type, text is not null as has_text from conversations")
def explode_turns(spark, sf_dir):
    return nested.flatten_variants(conversation_records(spark, sf_dir), keys=("conv_id",)).select("conv_id", "position", "intervention_type", "has_text")


def conversation_records(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("intervention_type"), t["text"].alias("text"), F.lit(None).cast("string").alias("reason_if_null"))).alias("variants"))


@query("PRJ2 PRJ3 ARR4 ARR12", "select conv_id, count(*) as n_variants, count(text) as n_with_text, count(*) - count(text) as n_null, count_if(role = 'system') > 0 as has_system from conversations group by conv_id")
def nested_counts(spark, sf_dir):
    r = conversation_records(spark, sf_dir)
    q = nested.flatten_questions(r, keys=("conv_id",)).join(r.select("conv_id", F.exists("variants", lambda v: v["intervention_type"] == "system").alias("has_system")), "conv_id")
    return q.withColumns({c: F.col(c).cast("bigint") for c in ("n_variants", "n_with_text", "n_null")})


@query("PRJ25 T5", "select conv_id, count(*) as n_main, count(*) + (case when count_if(role = 'control') = 0 then 1 else 0 end) as n_merged from conversations group by conv_id")
def merged_side_arrays(spark, sf_dir):
    r = conversation_records(spark, sf_dir)
    extra = F.array(*[F.struct(F.lit(k).alias("intervention_type"), F.lit(t).alias("text"), F.lit(None).cast("string").alias("reason_if_null")) for k, t in (("control", "a"), ("user", "b"), ("control", "c"))])
    return r.select("conv_id", F.size("variants").cast("bigint").alias("n_main"), F.size(rules.merge_side_array(F.col("variants"), extra)).cast("bigint").alias("n_merged"))


@query("PRJ30 PRJ31 FLT12", "select s_suppkey, case when s_suppkey % 3 = 0 then substr('ABCD', cast(s_suppkey % 4 as integer) + 1, 1) when s_suppkey % 3 = 1 then 'B' end as gold, length('Q' || cast(s_suppkey as varchar)) + 4 * length(chr(10) || 'A. w') + length(chr(10) || 'Answer:') as prompt_chars from supplier")
def gold_letters(spark, sf_dir):
    k = F.col("s_suppkey")
    options = F.create_map(*[F.lit(x) for p in (("A", "w"), ("B", "x"), ("C", "y"), ("D", "z")) for x in p])
    given = F.when(k % 3 == 0, F.get(F.array(*[F.lit(c) for c in "ABCD"]), (k % 4).cast("int"))).otherwise("")
    answer = F.when(k % 3 == 1, "x").otherwise("none")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", A.gold_letter(given, answer, options).alias("gold"), A.prompt(F.concat(F.lit("Q"), k.cast("string")), options).alias("prompt"))
    return rows.select("s_suppkey", "gold", F.length("prompt").cast("bigint").alias("prompt_chars"))


@query("PRJ38 PRJ35", "select distinct c_mktsegment, case when c_custkey % 2 = 0 then 'sex_gender' else 'sexual_orientation' end as family from customer")
def key_families(spark, sf_dir):
    key = F.when(F.col("c_custkey") % 2 == 0, "sex_gender_L3").otherwise("sexual_orientation_L4")
    return table(spark, sf_dir, "customer").select("c_mktsegment", rules.family_from_key(key, ["sex", "sex_gender", "sexual_orientation", "race"]).alias("family")).distinct()


@query("PRJ22 PRJ23 PRJ24", "select p_partkey, case when p_partkey % 3 = 0 then 'neutral_rework' else 'race_ethnicity' end as intervention_type, case p_partkey % 3 when 0 then null when 1 then 'omit_race' else 'Hispanic/Latino' end as value from part")
def normalized_variants(spark, sf_dir):
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k == 0, "control").when(k == 1, "omit_race").otherwise("race_ethnicity").alias("intervention_type"), F.when(k == 0, "Neutral rework").otherwise(" LATINA ").alias("attribute_value_counterfactual"),
        F.lit("white").alias("attribute_value_original"), F.lit("text").alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("medical_relevance", "social_bias_salience", "clinical_coherence", "gold_answer_invariance")],
    )
    return rules.normalize_variant(rows).select("p_partkey", "intervention_type", F.col("attribute_value_counterfactual").alias("value"))


@query("FLT4 FLT10 FLT11 FLT16 T7", "select l_returnflag, count(*) as n, count_if(l_quantity = l_quantity) as finite, count_if(l_linenumber is not null and l_tax <= 0.04) as aligned from lineitem where l_returnflag in ('R', 'A') and l_linestatus = 'O' and coalesce(l_discount, 0) <= 0.06 group by 1")
def cohort_filters(spark, sf_dir):
    failed = F.when(F.col("l_tax") > 0.04, F.lit(True)).when(F.col("l_tax").isNotNull(), F.lit(False))
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A") & (F.col("l_linestatus") == "O") & (F.coalesce("l_discount", F.lit(0.0)) <= 0.06))
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(~F.isnan("l_quantity")).alias("finite"), F.count_if(~F.coalesce(failed, F.lit(True))).alias("aligned"))

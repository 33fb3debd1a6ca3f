"""Nested records: layout sniffing, flattening, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.arrays import has_any
from pairloom.operators import registry as R

VARIANT = (
    "struct<variant_id:string,intervention_type:string,edit_scope:string,edit_strength:string,identity_explicitness:string,"
    "attribute_value_original:string,attribute_value_counterfactual:string,medical_relevance:string,social_bias_salience:string,"
    "counterfactual_validity:string,clinical_coherence:string,target_attribute_role:string,gold_answer_invariance:string,"
    "prior_shift_expected:string,annotation_confidence:double,rationale:string,text:string,reason_if_null:string,notes:string,"
    "uncertainty_flags:array<string>,evidence_spans:array<struct<span:string,role:string>>>"
)
LEGACY = f"map<string,map<string,{VARIANT}>>"
FLAT = f"array<{VARIANT}>"


def variants_from_json(raw: Column) -> Column:
    """ARR2: one array of variants from either layout, told apart by the first character. The legacy
    category becomes the type, its label the edited value. Other payloads give NULL (FLT1)."""
    first = F.left(F.ltrim(raw), F.lit(1))
    flat = F.from_json(raw, FLAT)
    legacy = F.flatten(
        F.transform(
            F.map_entries(F.from_json(raw, LEGACY)),
            lambda c: F.transform(
                F.map_entries(c["value"]),
                lambda v: v["value"].withField("intervention_type", c["key"]).withField("attribute_value_counterfactual", v["key"]),
            ),
        )
    )
    return F.when(first == "[", flat).when(first == "{", legacy)


def flatten_variants(records: DataFrame, variants: str = "variants", keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """PRJ1: a row per variant with its position; PRJ4: whether it has a text, or is identical; FLT1:
    missing arrays and entries give no row."""
    rows = records.select(*keys, F.posexplode(variants).alias("position", "v")).where("v is not null")
    reason = F.coalesce(F.lower("v.reason_if_null"), F.lit(""))
    identical = F.col("v.text").isNull() & reason.contains("identical")
    return rows.select(*keys, "position", "v.*", F.col("v.text").isNotNull().alias("has_text"), identical.alias("is_identical"))


def flatten_questions(records: DataFrame, cues: str | None = None, variants: str = "variants", keys: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """PRJ2/3: a row per record with the counts of its variants, and a flag for each cue array."""
    count = F.coalesce(F.size(variants), F.lit(0))
    filled = F.coalesce(F.size(F.filter(variants, lambda v: v["text"].isNotNull())), F.lit(0))
    flags = [has_any(F.col(f"{cues}.{f.name}")).alias(f"has_{f.name}") for f in records.schema[cues].dataType.fields] if cues else []
    return records.select(*keys, *flags, count.alias("n_variants"), filled.alias("n_with_text"), (count - filled).alias("n_null"))


def map_rows(records: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    """ARR1: a row per (category, label) of a map of maps."""
    outer = records.select(*keys, F.explode(column).alias("category", "inner"))
    return outer.select(*keys, "category", F.explode("inner").alias("label", "value"))


def expected_grid(spark: SparkSession) -> DataFrame:
    """ARR3: the 13 expected (category, label) pairs."""
    return spark.createDataFrame([(c, v) for c, values in R.EXPECTED_GRID.items() for v in values], "category string, label string")


def grid_lookup(ids: DataFrame, rows: DataFrame, spark: SparkSession, key: str = "question_id") -> DataFrame:
    """ARR3 / SET10: every id with every expected pair; ``present`` tells which exist. The grid is 13
    rows of constants, so the product is linear in the ids."""
    grid = ids.select(key).distinct().crossJoin(F.broadcast(expected_grid(spark)))
    have = rows.select(key, "category", "label").distinct().withColumn("present", F.lit(True))
    return grid.join(have, [key, "category", "label"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def missing_keys(m: Column, expected: list[str]) -> Column:
    """SET10"""
    return F.array_except(F.array(*[F.lit(e) for e in expected]), F.map_keys(m))

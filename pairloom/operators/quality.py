"""Validation: issues as a long table, tiers over annotation passes, fingerprints."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators import registry as R
from pairloom.operators import rules
from pairloom.operators.aggregates import majority


def _issues(df: DataFrame, keys: list[str], checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """(keys, field, message) for each check (field, wrong, message) that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(field).alias("field"), message.alias("message"))) for field, wrong, message in checks]))
    return df.select(*keys, F.explode(found).alias("i")).select(*keys, "i.field", "i.message")


def enum_issues(df: DataFrame, keys: list[str], enums: dict[str, list[str]] | None = None, strict: bool = False) -> DataFrame:
    """DQ2/DQ3/DQ4: values outside their enumeration. NULL passes, unless ``strict``."""
    checks = []
    for field, allowed in (enums or (R.ENUMS_STRICT if strict else R.ENUMS_FLAT)).items():
        wrong = ~F.coalesce(F.col(field), F.lit("")).isin(allowed) if strict else F.col(field).isNotNull() & ~F.col(field).isin(allowed)
        checks.append((field, wrong, F.concat(F.lit(f"invalid {field}: "), F.coalesce(F.col(field), F.lit("")))))
    return _issues(df, keys, checks)


def control_issues(df: DataFrame, keys: list[str]) -> DataFrame:
    """DQ3: controls must be irrelevant and of low salience; names implicit, pronouns linguistic."""
    control = F.col("intervention_type").isin(R.CONTROLS)

    def unlike(column: str, value: str) -> Column:
        return ~F.col(column).eqNullSafe(value)

    return _issues(df, keys, [
        ("medical_relevance", control & unlike("medical_relevance", "irrelevant"), F.lit("control must be irrelevant")),
        ("social_bias_salience", control & unlike("social_bias_salience", "low"), F.lit("control must have low salience")),
        ("identity_explicitness", (F.col("intervention_type") == "name") & unlike("identity_explicitness", "implicit"), F.lit("name must be implicit")),
        ("identity_explicitness", (F.col("intervention_type") == "pronoun") & unlike("identity_explicitness", "linguistic"), F.lit("pronoun must be linguistic")),
    ])


def strict_issues(df: DataFrame, keys: list[str], registry: DataFrame) -> DataFrame:
    """DQ4: enumerations (a missing field is wrong, T21), registry fields, ladder, range, required texts."""
    reg = registry.select("intervention_type", *[F.col(c).alias(f"_{c}") for c in ("intervention_family", "semantic_class", "analysis_bucket", "ladder_applicable")])
    joined = df.join(reg, "intervention_type", "left")
    checks = [(f, F.col(f"_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f"{f} differs from the registry")) for f in ("intervention_family", "semantic_class", "analysis_bucket")]
    checks += [
        ("edit_strength", ~F.col("_ladder_applicable") & ~F.col("edit_strength").eqNullSafe("single"), F.lit("no ladder but not single")),
        ("annotation_confidence", ~F.col("annotation_confidence").between(0.0, 1.0), F.lit("out of range")),
        ("rationale", F.coalesce(F.col("rationale"), F.lit("")) == "", F.lit("missing")),
        ("reason_if_null", F.col("text").isNull() & (F.coalesce(F.col("reason_if_null"), F.lit("")) == ""), F.lit("text is null without a reason")),
    ]
    return enum_issues(df, keys, strict=True).unionByName(control_issues(df, keys)).unionByName(_issues(joined, keys, checks))


def structure_issues(rows: DataFrame, grid: DataFrame, key: str = "question_id") -> DataFrame:
    """DQ2: expected (category, label) pairs that a record lacks."""
    return grid.where(~F.col("present")).select(key, F.concat_ws("/", F.lit("variants"), "category", "label").alias("path"), F.lit("missing key").alias("message"))


SCHEMA_KINDS = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def compile_schema(schema: dict, path: str = "") -> list[tuple[str, dict]]:
    """SRC13: a JSON Schema as (dotted path, rules) of its leaves; arrays and maps are leaves."""
    out = []
    required = set(schema.get("required", []))
    for name, sub in schema.get("properties", {}).items():
        where = f"{path}.{name}" if path else name
        if sub.get("type") == "object" and "properties" in sub:
            out += compile_schema(sub, where)
        else:
            out.append((where, {"required": name in required, **{k: sub[k] for k in ("type", "enum", "minimum", "maximum", "pattern") if k in sub}}))
    return out


def schema_issues(df: DataFrame, json_column: str, schema: dict, keys: list[str]) -> DataFrame:
    """DQ1: all violations with their path, by predicates made from the schema over a JSON string."""
    checks = []
    for path, rule in compile_schema(schema):
        value = F.get_json_object(json_column, "$." + path)
        if rule["required"]:
            checks.append((path, value.isNull() & ~F.array_contains(F.array(*[F.lit(str(t)) for t in ([rule.get("type")] if not isinstance(rule.get("type"), list) else rule["type"])]), "null"), F.lit("missing")))
        if "enum" in rule:
            checks.append((path, value.isNotNull() & ~value.isin([str(e) for e in rule["enum"] if e is not None]), F.lit("not in enumeration")))
        if "minimum" in rule:
            checks.append((path, F.expr(f"try_cast(get_json_object({json_column}, '$.{path}') as double) < {rule['minimum']}"), F.lit("below minimum")))
        if "maximum" in rule:
            checks.append((path, F.expr(f"try_cast(get_json_object({json_column}, '$.{path}') as double) > {rule['maximum']}"), F.lit("above maximum")))
        if "pattern" in rule:
            checks.append((path, value.isNotNull() & ~value.rlike(rule["pattern"]), F.lit("pattern")))
    return _issues(df, keys, checks)


def high_edits(df: DataFrame, ratio: str, threshold: float = 0.35) -> DataFrame:
    """DQ5"""
    return df.where(F.col(ratio) > threshold)


def reconcile(passes: DataFrame, keys: list[str], order: str, critical_flags: list[str], sequence: str | None = None) -> DataFrame:
    """DQ6: majority labels, agreement and tier of each key over its annotation passes (a row each). Confidences are
    added up in the order of ``sequence`` (default ``order``), which should have no ties within a key: in another order
    the mean's last place is another, and a mean at a tier's edge falls on the other side."""
    reason = F.coalesce(F.lower("reason_if_null"), F.lit(""))
    state = F.when(F.col("text").isNull() & reason.contains("identical"), "identical").when(F.col("text").isNull(), "null").otherwise("has_text")
    # one shuffle by the key serves every aggregation below: a key has as many rows as passes
    df = passes.withColumn("text_state", state).repartition(*keys)
    flags = F.flatten(F.collect_list(F.coalesce("uncertainty_flags", F.array().cast("array<string>"))))
    sure = F.array_sort(F.collect_list(F.when(F.col("annotation_confidence").isNotNull(), F.struct(F.col(sequence or order).alias("at"), F.col("annotation_confidence").cast("double").alias("x")))))  # a key's passes
    mean = F.try_divide(F.aggregate(sure, F.lit(0.0), lambda total, c: total + c["x"]), F.size(sure))
    out = df.groupBy(*keys).agg(
        F.coalesce(mean, F.lit(0.5)).alias("mean_confidence"),
        F.min_by("text", F.when(F.col("text").isNotNull(), F.col(order))).alias("text"),
        F.size(F.array_intersect(F.array_distinct(flags), F.array(*[F.lit(f) for f in critical_flags]))).alias("critical"),
        F.count("*").alias("n_passes"),
    )
    fields = ["text_state", *R.CRITICAL_FIELDS]
    votes = df.select(*keys, order, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("v")).select(*keys, order, "v.field", "v.value")
    voted = majority(votes, [*keys, "field"], "value", order)
    wide = voted.groupBy(*keys).agg(*[F.max(F.when(F.col("field") == f, F.col(c))).alias(f"{f}_{name}") for f in fields for c, name in (("majority", "majority"), ("majority_frac", "frac"), ("unanimous", "unanimous"))])
    out = out.join(wide, keys, "left")
    unanimous = F.lit(True)
    for field in R.CRITICAL_FIELDS:
        unanimous = unanimous & F.coalesce(F.col(f"{field}_unanimous"), F.lit(False))
    least = F.least(*[F.coalesce(F.col(f"{field}_frac"), F.lit(0.0)) for field in R.CRITICAL_FIELDS])
    named = [F.col(f"{f}_majority") for f in R.CRITICAL_FIELDS]
    return out.withColumn("tier", rules.tier(F.col("text_state_majority"), unanimous, *named, F.col("mean_confidence"), F.col("critical"), least))


def change_counts(before: Column, after: Column, name: str) -> Column:
    """DQ7, an aggregate: rows a step has changed."""
    return F.count_if(~before.eqNullSafe(after)).alias(name)


def id_counts(df: DataFrame, key: str) -> DataFrame:
    """DQ8: rows, missing ids, distinct ids, duplicates."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col(key).isNull()).alias("missing"), F.count_distinct(key).alias("distinct"), (F.count(key) - F.count_distinct(key)).alias("duplicates"))


def fingerprint(config: dict) -> str:
    """DQ9: of a run's configuration, independent of the order of its keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def check_fingerprint(found: str | None, config: dict) -> None:
    """DQ9: refuse to reuse the results of another configuration."""
    if found is not None and found != fingerprint(config):
        raise ValueError("results belong to another configuration")


def low_support(df: DataFrame, group: str, least: int) -> DataFrame:
    """DQ12: a warning for each group with too few rows."""
    counts = df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < least)
    return counts.select(group, F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" rows")).alias("warning"))


def dry_run(df: DataFrame, steps: dict[str, Callable[[DataFrame], DataFrame]], n: int = 5) -> DataFrame:
    """DQ13: every step of a plan on a few rows, one after the other: (step, ok, rows, columns, error). A
    step that fails ends the run."""
    spark, out, part = df.sparkSession, [], df.limit(n)
    for name, step in steps.items():
        try:
            part = spark.createDataFrame((made := step(part)).collect(), made.schema)
            out.append((name, True, part.count(), ",".join(part.columns), None))
        except Exception as error:  # noqa: BLE001  any failure is the finding
            out.append((name, False, 0, "", str(error)[:200]))
            break
    return spark.createDataFrame(out, "step string, ok boolean, rows bigint, columns string, error string")


def self_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """DQ10: (name, n, passed): for each check, the rows there are and those for which it holds."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return counts.select("n", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("passed")) for n in checks])).alias("c")).select("c.name", "n", "c.passed")

"""Rule engines as column expressions: analysis classes, normalisers, families, tiers.

Four class rules go by one name in the field and differ; they are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import first_truthy, folded_label, slug
from pairloom.operators import registry as R


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's entry, else the value itself."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, value), value)


def _identical(reason: Column) -> Column:
    return F.coalesce(F.lower(reason).contains("identical"), F.lit(False))


def _clean(validity, coherence, invariance) -> Column:
    return (validity == "valid") & (coherence == "preserved") & invariance.isin("invariant", "likely_invariant")


def _usable(validity, coherence) -> Column:
    return validity.isin("valid", "questionable") & coherence.isin("preserved", "weakened")


def class_summary(text, reason, validity, coherence, relevance, invariance) -> Column:
    """PRJ5: for summaries of flat rows; NULL where no rule applies."""
    return (
        F.when(text.isNull() & _identical(reason), "identical")
        .when(text.isNull(), "class3")
        .when(_clean(validity, coherence, invariance) & (relevance == "irrelevant"), "class1")
        .when(_usable(validity, coherence) & relevance.isin("epidemiologic", "mechanistically_causal"), "class2")
        .when((validity == "invalid") | (coherence == "broken"), "class3")
    )


def class_validator(text, reason, validity, coherence, role, invariance) -> Column:
    """PRJ6: for legacy records."""
    return (
        F.when(text.isNull() & _identical(reason), "identical")
        .when(text.isNull(), "class3")
        .when(_clean(validity, coherence, invariance) & role.isin("irrelevant", "socially_loaded"), "class1")
        .when(_usable(validity, coherence) & role.isin("epidemiologic", "mechanistically_causal"), "class2")
        .when((validity == "invalid") | (coherence == "broken") | (role == "sex_specific"), "class3")
        .otherwise("unclassified")
    )


def class_extract(text, reason, validity, coherence, role, relevance, invariance) -> Column:
    """PRJ7: for extraction; the relevance stands in for a missing role, ambiguous is class2, and so
    is everything left."""
    role = first_truthy(F.trim(role), F.trim(relevance))
    return (
        F.when(text.isNull() & _identical(reason), "identical")
        .when(text.isNull(), "excluded")
        .when(_clean(F.trim(validity), F.trim(coherence), F.trim(invariance)) & role.isin("irrelevant", "socially_loaded"), "class1")
        .when(_usable(F.trim(validity), F.trim(coherence)) & role.isin("epidemiologic", "mechanistically_causal", "ambiguous"), "class2")
        .when((F.trim(validity) == "invalid") | (F.trim(coherence) == "broken"), "class3")
        .otherwise("class2")
    )


def class_trace(text, reason, validity, coherence, role, invariance) -> Column:
    """PRJ8: for tracing and repair; no stand-in for the role."""
    return (
        F.when(text.isNull() & _identical(reason), "identical")
        .when(text.isNull(), "excluded")
        .when(_clean(validity, coherence, invariance) & role.isin("irrelevant", "socially_loaded"), "class1")
        .when(_usable(validity, coherence) & role.isin("epidemiologic", "mechanistically_causal"), "class2")
        .when((validity == "invalid") | (coherence == "broken"), "class3")
        .otherwise("class2")
    )


# ------------------------------------------------------------ normalisers


def type_analysis(*names: Column) -> Column:
    """PRJ9/10: the first non-empty of the alternative fields, aliased; unknown if there is none."""
    return F.coalesce(mapped(first_truthy(*names), R.ALIASES_ANALYSIS), F.lit("unknown"))


def type_extraction(name: Column) -> Column:
    """PRJ9: trimmed, six aliases, empty for NULL."""
    return mapped(F.trim(F.coalesce(name, F.lit(""))), R.ALIASES_EXTRACTION)


def group_analysis(kind: Column, bucket: Column, legacy_class: Column, subtype: Column) -> Column:
    """PRJ11: bucket, legacy class, type sets, subtype, other."""
    by_type = F.when(kind.isin(R.STRUCTURAL_TYPES), "structural_context").when(kind.isin(R.IDENTITY_TYPES), "identity_bias")
    core = kind.isin([*R.CORE_TYPES, "gender", "race"])
    return (
        F.when(bucket.isin(R.BUCKETS), bucket)
        .when((legacy_class == "control") | kind.isin(R.CONTROLS), "control")
        .when(legacy_class.isin("class1", "class2", "class3"), F.coalesce(by_type, F.lit("core_bias")))
        .when(by_type.isNotNull(), by_type)
        .when(core, "core_bias")
        .when(subtype.isin(R.CONTROLS), "control")
        .otherwise("other")
    )


def group_extraction(kind: Column, bucket: Column, legacy_class: Column) -> Column:
    """PRJ12: control first, then bucket, then type sets, unknown."""
    kind = type_extraction(kind)
    return (
        F.when((legacy_class == "control") | kind.isin([*R.CONTROLS, "control"]), "control")
        .when(F.trim(bucket).isin(R.BUCKETS), F.trim(bucket))
        .when(kind.isin(R.CORE_TYPES), "core_bias")
        .when(kind.isin(R.IDENTITY_TYPES), "identity_bias")
        .when(kind.isin(R.STRUCTURAL_TYPES), "structural_context")
        .otherwise("unknown")
    )


def control_subtype_analysis(subtype: Column, kind: Column) -> Column:
    """PRJ13"""
    return F.when(subtype.isin(R.CONTROLS), subtype).when(kind.isin(R.CONTROLS), kind)


def control_subtype_extraction(kind: Column, *candidates: Column) -> Column:
    """PRJ13: the first candidate that is a control, the type itself last."""
    out = F.lit(None).cast("string")
    for c in reversed([*candidates, kind]):
        out = F.when(F.trim(c).isin(R.CONTROLS), F.trim(c)).otherwise(out)
    return F.coalesce(out, F.when(type_extraction(kind) == "control", "unknown_control").otherwise("none"))


def locality_analysis(locality: Column, strength: Column, scope: Column, changed: Column) -> Column:
    """PRJ14: what is given, then strength and scope, then bands of changed tokens (3 and 12)."""
    return (
        F.when(locality.isin("minimal", "sentence_level", "broader", "single"), locality)
        .when(strength == "minimal", "minimal")
        .when((strength == "single") & scope.isin("token", "phrase"), "single")
        .when(scope == "sentence", "sentence_level")
        .when(scope == "multi_sentence", "broader")
        .when(scope.isin("token", "phrase"), "minimal")
        .when(changed <= 3, "minimal")
        .when(changed <= 12, "single")
        .when(changed.isNotNull(), "broader")
        .otherwise("unknown")
    )


def locality_extraction(locality: Column, strength: Column, scope: Column) -> Column:
    """PRJ14: locality, else a known strength, else the scope, else NULL."""
    known = F.when(F.trim(strength).isin("minimal", "moderate", "strong", "single"), F.trim(strength))
    return first_truthy(F.trim(locality), known, F.trim(scope))


def with_normalized(df: DataFrame) -> DataFrame:
    """PRJ15/16: five normalized_* columns from whichever fields there are."""

    def field(name: str) -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast("string")

    kind = type_analysis(*[field(n) for n in ("intervention_type", "attribute_type", "attribute", "dimension")])
    changed = field("n_tokens_changed").cast("double")
    return df.withColumns({
        "normalized_attribute": kind,
        "normalized_group": group_analysis(kind, field("analysis_bucket"), field("analysis_class"), field("control_subtype")),
        "normalized_control_subtype": control_subtype_analysis(field("control_subtype"), kind),
        "normalized_edit_locality": locality_analysis(field("edit_locality"), field("edit_strength"), field("edit_scope"), changed),
        "normalized_label": first_truthy(*[field(n) for n in ("label", "attribute_value_counterfactual", "counterfactual_value", "value")]),
    })


def display_type(kind: Column) -> Column:
    """PRJ17"""
    return mapped(type_extraction(kind), R.DISPLAY)


def group_name(group: Column) -> Column:
    """PRJ17"""
    return mapped(group, R.GROUP_NAMES)


def _holds(label: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(label.contains(p), F.lit(False))
    return out


def _family(kind: Column, is_identity: Column) -> Column:
    return (
        F.when(kind.isin(R.CONTROLS), "control")
        .when(kind.isin("race_ethnicity", "omit_race"), "race")
        .when(kind == "sexual_orientation", "sexual_orientation")
        .when(kind == "gender_identity", "gender_identity")
        .when(kind.isin("sex", "sex_gender") & is_identity, "gender_identity")
        .when(kind.isin("sex", "sex_gender"), "sex_gender")
    )


def family_late(kind: Column, label: Column) -> Column:
    """PRJ18: stages that fold punctuation first; a fragment with a hyphen can't match there."""
    return _family(F.trim(kind), _holds(folded_label(label), R.GENDER_IDENTITY_FRAGMENTS))


def family_heads(kind: Column, value: Column, label: Column) -> Column:
    """PRJ18: head localisation; lower-cased only, a longer list of labels."""
    return _family(kind, _holds(F.trim(F.lower(first_truthy(value, label))), R.GENDER_IDENTITY_LABELS))


def orientation_split(label: Column) -> Column:
    """PRJ19: partner is checked before explicit."""
    return F.when(_holds(label, R.PARTNER_FRAGMENTS), "partner").when(_holds(label, R.EXPLICIT_FRAGMENTS), "explicit").otherwise("other")


def salience_rank(value: Column) -> Column:
    return F.when(value == "high", 2).when(value == "moderate", 1).otherwise(0)


def max_salience(a: Column, b: Column) -> Column:
    """PRJ21: unknown values count as low."""
    return F.get(F.array(*[F.lit(s) for s in R.SALIENCE]), F.greatest(salience_rank(a), salience_rank(b)))


def race_label(value: Column) -> Column:
    """PRJ23"""
    table = F.create_map(*[F.lit(x) for pair in R.RACE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), value)


def attach_static(df: DataFrame, registry: DataFrame) -> DataFrame:
    """PRJ20 / JN12: registry fields (UNKNOWN without an entry), hard rules, salience floors, confidence
    caps and the variant's id. Needs intervention_type, edit_strength, identity_explicitness,
    medical_relevance, social_bias_salience, annotation_confidence, attribute_value_counterfactual,
    text. The registry has 21 rows; Spark broadcasts it by its size."""
    fields = ["intervention_family", "semantic_class", "analysis_bucket", "ladder_applicable"]
    joined = df.drop(*fields).join(registry.select("intervention_type", *fields), "intervention_type", "left")
    kind, known = F.col("intervention_type"), F.col("ladder_applicable").isNotNull()
    control = kind.isin(R.CONTROLS)
    strength = F.coalesce("edit_strength", F.lit("single"))
    strength = F.when(known & (control | (~F.col("ladder_applicable") & strength.isin("minimal", "moderate", "strong"))), "single").otherwise(strength)
    explicit = (
        F.when(kind == "name", "implicit").when(kind == "pronoun", "linguistic").when(kind.isin("gender_identity", "insurance_status", "housing_status"), "explicit").otherwise(F.col("identity_explicitness"))
    )
    floor = F.when(kind.isin(list(R.SALIENCE_FLOOR)), max_salience(F.col("social_bias_salience"), F.lit("moderate"))).otherwise(F.col("social_bias_salience"))
    conf = F.col("annotation_confidence").cast("double")
    cap = (
        F.when(control, 1.0)
        .when(F.col("text").isNull(), 0.98)
        .when(kind.isin("gender_identity", "sexual_orientation", "insurance_status", "housing_status"), 0.90)
        .when(kind.isin("race_ethnicity", "name", "pronoun"), 0.95)
    )
    capped = F.when(conf.isNotNull(), F.round(F.least(conf, F.coalesce(cap, conf)), 3))
    value = slug(F.col("attribute_value_counterfactual"))
    name = F.when(known, F.concat_ws(".", kind, value, slug(F.col("edit_strength")))).otherwise(F.concat_ws(".", F.lit("unknown"), value, F.lit("single")))
    ruled = joined.withColumns({
        "edit_strength": strength,
        "identity_explicitness": F.when(known, explicit).otherwise(F.col("identity_explicitness")),
        "medical_relevance": F.when(known & control, "irrelevant").otherwise(F.col("medical_relevance")),
        "social_bias_salience": F.when(known & control, "low").when(known, floor).otherwise(F.col("social_bias_salience")),
        "annotation_confidence": F.when(known, capped).otherwise(conf),
    })
    return ruled.withColumns({"variant_id": name, "ladder_applicable": F.coalesce("ladder_applicable", F.lit(False))} | {f: F.coalesce(f, F.lit("UNKNOWN")) for f in fields[:3]})


def normalize_variant(df: DataFrame) -> DataFrame:
    """PRJ22: answer block cut, control and omit_race types resolved, race labels, control fields."""
    from pairloom.functions.text import strip_choices

    said = F.lower(F.trim(F.coalesce("attribute_value_counterfactual", F.lit(""))))
    kind = F.col("intervention_type")
    resolved = F.when((kind == "control") & said.isin("neutral_rework", "neutral rework"), "neutral_rework").when((kind == "control") & said.isin("irrelevant_surface", "irrelevant surface"), "irrelevant_surface").when(kind == "omit_race", "race_ethnicity").otherwise(kind)
    out = df.withColumns({
        "text": strip_choices(F.col("text")),
        "attribute_value_counterfactual": F.when(kind == "omit_race", "omit_race").otherwise(F.col("attribute_value_counterfactual")),
        "intervention_type": resolved,
    })
    kind = F.col("intervention_type")
    control, race = kind.isin(R.CONTROLS), kind == "race_ethnicity"

    def label(c: str) -> Column:
        return F.when(control, F.lit(None)).when(race, race_label(F.col(c))).otherwise(F.col(c))

    return out.withColumns({
        "attribute_value_counterfactual": label("attribute_value_counterfactual"),
        "attribute_value_original": label("attribute_value_original"),
        "medical_relevance": F.when(control, "irrelevant").otherwise(F.col("medical_relevance")),
        "social_bias_salience": F.when(control, "low").otherwise(F.col("social_bias_salience")),
        "clinical_coherence": F.when(control, F.coalesce("clinical_coherence", F.lit("preserved"))).otherwise(F.col("clinical_coherence")),
        "gold_answer_invariance": F.when(control, F.coalesce("gold_answer_invariance", F.lit("invariant"))).otherwise(F.col("gold_answer_invariance")),
    })


def merge_side_array(main: Column, side: Column) -> Column:
    """PRJ25: entries of the side array whose type isn't there yet; of two side entries of a type the
    first comes in, since the array grows as it is merged."""
    same = lambda c: lambda v: v["intervention_type"].eqNullSafe(c["intervention_type"])  # noqa: E731  a missing type is a type
    fresh = F.filter(side, lambda c, i: ~F.exists(main, same(c)) & ~F.exists(F.slice(side, F.lit(1), i), same(c)))
    return F.concat(main, F.coalesce(fresh, F.slice(main, 1, 0)))


# ------------------------------------------------------------ layers and heads


def layer_region(layer: Column) -> Column:
    """PRJ26: hidden-state index, 0 is the embedding."""
    return F.when(layer == 0, "embedding").when(layer < 4, "early").when(layer < 16, "mid").otherwise("late")


def block_region(block: Column) -> Column:
    """PRJ26: block index, one less than the hidden-state index."""
    return layer_region(block + 1)


def quarter_region(layer: Column, n_layers: int) -> Column:
    """PRJ27: quarters of the depth."""
    q = n_layers // 4
    return F.when(layer < q, "q1").when(layer < 2 * q, "q2").when(layer < 3 * q, "q3").otherwise("q4")


def head_key(layer: Column, head: Column) -> Column:
    """PRJ28"""
    return F.format_string("L%02dH%02d", layer, head)


def family_from_key(key: Column, families: list[str]) -> Column:
    """PRJ38: the longest known family that the key begins with, else its first token."""
    out = F.substring_index(key, "_", 1)
    for f in sorted(families, key=len):
        out = F.when(key.startswith(f), f).otherwise(out)
    return out


def tier(text_state: Column, unanimous: Column, validity: Column, coherence: Column, role: Column, invariance: Column, confidence: Column, critical_flags: Column, least_fraction: Column) -> Column:
    """DQ6: from majority labels, their unanimity and least majority fraction, the mean confidence and
    the number of critical uncertainty flags."""
    sure = unanimous & (confidence >= 0.8) & (critical_flags == 0) & (validity == "valid") & (coherence == "preserved")
    return (
        F.when(text_state == "identical", "identical")
        .when(text_state == "null", "tier3")
        .when((validity == "invalid") | (coherence == "broken"), "tier3")
        .when(sure & role.isin("irrelevant", "socially_loaded") & invariance.isin("invariant", "likely_invariant"), "tier1")
        .when(sure & role.isin("epidemiologic", "mechanistically_causal"), "tier1_medical")
        .when((least_fraction >= 0.5) & validity.isin("valid", "questionable") & (confidence >= 0.5), "tier2")
        .when(confidence < 0.5, "tier3")
        .otherwise("tier2")
    )

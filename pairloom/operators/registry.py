"""Registries: intervention types, enumerations, pattern tables, thresholds.

They are dimension data. As DataFrames (:func:`intervention_registry` and the
like) they are joined, as constants they go into expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values. They must equal those of the data's producers.
# ---------------------------------------------------------------------------

# type, family, semantic class, bucket, ladder, tier
INTERVENTIONS = [
    ("sex", "biological", "biological", "core_bias", True, "1"),
    ("age", "biological", "biological", "core_bias", False, "1"),
    ("race_ethnicity", "identity", "social_identity", "core_bias", True, "1"),
    ("pronoun", "linguistic", "linguistic_marker", "core_bias", True, "1"),
    ("name", "linguistic", "linguistic_marker", "core_bias", True, "1"),
    ("pregnancy_status", "biological", "biological", "core_bias", False, "1"),
    ("reproductive_status", "biological", "biological", "core_bias", False, "1"),
    ("neutral_rework", "control", "pure_surface", "control", False, "1"),
    ("irrelevant_surface", "control", "pure_surface", "control", False, "1"),
    ("sexual_orientation", "identity", "social_identity", "identity_bias", True, "2"),
    ("gender_identity", "identity", "social_identity", "identity_bias", False, "2"),
    ("kinship_role", "linguistic", "linguistic_marker", "identity_bias", True, "2"),
    ("disability_identity", "identity", "social_identity", "identity_bias", False, "2"),
    ("insurance_status", "social_context", "social_context", "structural_context", False, "3a"),
    ("housing_status", "social_context", "social_context", "structural_context", False, "3a"),
    ("occupation", "social_context", "social_context", "structural_context", False, "3a"),
    ("marital_status", "social_context", "social_context", "structural_context", False, "3a"),
    ("socioeconomic_status", "social_context", "social_context", "structural_context", False, "3b"),
    ("family_structure", "social_context", "social_context", "structural_context", False, "3b"),
    ("nationality", "identity", "social_identity", "structural_context", False, "3b"),
    ("religion", "identity", "social_identity", "structural_context", False, "3b"),
]
TIERS = {"1": ["1"], "2": ["2"], "3": ["3a", "3b"], "3a": ["3a"], "3b": ["3b"]}
CONTROLS = ["neutral_rework", "irrelevant_surface"]
BUCKETS = ["core_bias", "identity_bias", "structural_context", "control"]
CORE_TYPES = ["sex", "age", "race_ethnicity", "pronoun", "name", "pregnancy_status", "reproductive_status"]
IDENTITY_TYPES = ["gender_identity", "sexual_orientation", "honorific", "kinship_role", "disability_identity"]
STRUCTURAL_TYPES = ["insurance_status", "housing_status", "occupation", "marital_status", "socioeconomic_status", "family_structure", "nationality", "religion"]
ALIASES_ANALYSIS = {"gender": "sex", "race": "race_ethnicity"}
ALIASES_EXTRACTION = {"gender": "sex", "race": "race_ethnicity", "housing": "housing_status", "insurance": "insurance_status", "marital": "marital_status", "kinship": "kinship_role"}
DISPLAY = {
    "sex": "gender", "age": "age", "race_ethnicity": "race", "pronoun": "pronoun", "name": "name", "pregnancy_status": "pregnancy",
    "reproductive_status": "reproductive", "sexual_orientation": "sexual_orientation", "gender_identity": "gender_identity",
    "kinship_role": "kinship", "honorific": "honorific", "disability_identity": "disability", "insurance_status": "insurance",
    "housing_status": "housing", "occupation": "occupation", "marital_status": "marital", "socioeconomic_status": "socioeconomic",
    "family_structure": "family", "nationality": "nationality", "religion": "religion", "neutral_rework": "control",
    "irrelevant_surface": "control", "control": "control",
}
GROUP_NAMES = {"core_bias": "Core bias", "identity_bias": "Identity bias", "structural_context": "Structural context", "control": "Control", "other": "Other"}
LADDER_TYPES = ["sex", "race_ethnicity", "pronoun", "name", "sexual_orientation", "kinship_role"]
SALIENCE = ["low", "moderate", "high"]
SALIENCE_FLOOR = {"gender_identity": "moderate", "sexual_orientation": "moderate", "race_ethnicity": "moderate", "insurance_status": "moderate", "housing_status": "moderate"}
ENUMS_FLAT = {
    "intervention_type": [i[0] for i in INTERVENTIONS] + ["honorific"],
    "analysis_bucket": BUCKETS,
    "medical_relevance": ["irrelevant", "epidemiologic", "mechanistically_causal", "ambiguous"],
    "social_bias_salience": SALIENCE,
    "counterfactual_validity": ["valid", "questionable", "invalid"],
    "clinical_coherence": ["preserved", "weakened", "broken"],
    "gold_answer_invariance": ["invariant", "likely_invariant", "uncertain", "likely_changed"],
    "edit_strength": ["minimal", "moderate", "strong", "single"],
}
ENUMS_STRICT = ENUMS_FLAT | {
    "intervention_type": [i[0] for i in INTERVENTIONS],
    "edit_scope": ["token", "phrase", "sentence", "multi_sentence"],
    "identity_explicitness": ["implicit", "explicit", "role_based", "linguistic"],
    "prior_shift_expected": ["none", "mild", "moderate", "strong"],
}
ENUMS_LEGACY = {
    "counterfactual_validity": ["valid", "questionable", "invalid"],
    "clinical_coherence": ["preserved", "weakened", "broken"],
    "target_attribute_role": ["irrelevant", "epidemiologic", "mechanistically_causal", "sex_specific", "socially_loaded"],
    "gold_answer_invariance": ["invariant", "likely_invariant", "uncertain", "likely_changed"],
    "prior_shift_expected": ["none", "mild", "moderate", "strong"],
    "edit_locality": ["minimal", "sentence_level", "multi_sentence"],
}
EXPECTED_GRID = {
    "gender": ["male", "female", "neutral"],
    "age": ["young_adult", "middle_aged", "elderly"],
    "race_ethnicity": ["White", "Black/African American", "Hispanic/Latino", "Asian", "no_race_specified"],
    "control": ["neutral_rework", "irrelevant_surface"],
}
CRITICAL_FIELDS = ["counterfactual_validity", "clinical_coherence", "target_attribute_role", "gold_answer_invariance"]
RACE_LABELS = {
    "black": "Black/African American", "black or african american": "Black/African American", "african american": "Black/African American",
    "african-american": "Black/African American", "hispanic": "Hispanic/Latino", "hispanic or latino": "Hispanic/Latino",
    "latino": "Hispanic/Latino", "latina": "Hispanic/Latino", "native american": "Native American/Alaska Native",
    "native american or alaska native": "Native American/Alaska Native", "alaska native": "Native American/Alaska Native",
    "american indian": "Native American/Alaska Native", "white": "White", "caucasian": "White", "asian": "Asian",
}
GENDER_IDENTITY_FRAGMENTS = ["non-binary", "nonbinary", "non binary", "transgender", "trans man", "trans woman", "transman", "transwoman", "gender non-conforming", "genderqueer", "agender"]
GENDER_IDENTITY_LABELS = ["non-binary person", "non-binary", "nonbinary", "transgender man", "transgender woman", "trans man", "trans woman", "transman", "transwoman", "gender non-conforming", "genderqueer", "agender"]
PARTNER_FRAGMENTS = ["partner", "same sex partner", "partner same sex"]
EXPLICIT_FRAGMENTS = ["gay", "straight", "lesbian", "bisexual", "queer", "heterosexual", "homosexual"]
EXPECTED_REGIONS = {"gender_identity": ["early"], "race": ["early"], "sex_gender": ["early", "mid"], "sexual_orientation": ["mid", "late"]}
ANSWER_BLOCK = r"(?s)\n\s*Answer choices:\s*\n\s*[A-D]\..+(?:\n\s*[A-D]\..+)*\s*$"
CHILD_HOUSING = [
    (r"(?i)\ba currently unhoused (\d+-year-old (?:boy|girl|child))", "A $1 whose family is currently unhoused"),
    (r"(?i)\ban? currently unhoused (\d+-year-old (?:boy|girl|child))", "A $1 whose family is currently unhoused"),
    (r"(?i)\ba (\d+-year-old (?:boy|girl|child)) living in a shelter", "A $1 living in a shelter with family"),
    (r"(?i)\ban? unhoused (\d+-year-old (?:boy|girl|child))", "A $1 whose family is currently unhoused"),
]

AGE_PATTERN = r"\b(\d{1,3})[ -]?(year|yr|y/?o|month|mo)[ -]?(old|s)?\b"
AGE_GROUP_TERMS = {
    "infant": r"\b(infant|newborn|neonate|baby)\b",
    "child": r"\b(child|pediatric|toddler|preschool)\b",
    "adolescent": r"\b(adolescent|teenager|teen|puberty)\b",
    "elderly": r"\b(elderly|geriatric|older adult|senior citizen)\b",
}
AUDIT_PATTERNS = {
    "sex": {
        "male": r"\b(male|man|boy|gentleman)\b",
        "female": r"\b(female|woman|girl|lady)\b",
    },
    "race": {
        "White/Caucasian": r"\b(white|caucasian|european[ -]?american)\b",
        "Black/African American": r"\b(black|african[ -]?american|african american)\b",
        "Hispanic/Latino": r"\b(hispanic|latino|latina|latinx|mexican[ -]?american|puerto rican|cuban)\b",
        "Asian": r"\b(asian|chinese|japanese|korean|vietnamese|filipino|indian|south asian|east asian|southeast asian)\b",
        "Native American": r"\b(native american|american indian|indigenous|alaska native|first nations)\b",
        "Pacific Islander": r"\b(pacific islander|hawaiian|samoan|polynesian)\b",
        "Middle Eastern": r"\b(middle eastern|arab|persian|iranian|iraqi|syrian|lebanese|turkish)\b",
        "Ashkenazi Jewish": r"\b(ashkenazi|jewish)\b",
        "Amish": r"\b(amish)\b",
    },
    "sexual_orientation": {
        "gay": r"\b(gay|homosexual)\b",
        "lesbian": r"\b(lesbian)\b",
        "bisexual": r"\b(bisexual)\b",
        "heterosexual": r"\b(heterosexual|straight)\b",
        "partner_same_sex_cue": r"\b(his (husband|boyfriend|male partner)|her (wife|girlfriend|female partner))\b",
        "relationship_cue": r"\b(husband|wife|spouse|partner|boyfriend|girlfriend|significant other|fiancé|fiancée)\b",
    },
    "gender_identity": {
        "transgender": r"\b(transgender|trans man|trans woman|transman|transwoman|trans male|trans female)\b",
        "nonbinary": r"\b(nonbinary|non-binary|genderqueer|gender[ -]?fluid|agender)\b",
        "hormone_therapy_cue": r"\b(hormone replacement therapy|HRT|testosterone therapy|estrogen therapy|gender[ -]?affirming)\b",
    },
    "insurance": {
        "uninsured": r"\b(uninsured|no insurance|lacks insurance|without insurance|no health insurance)\b",
        "Medicaid": r"\b(medicaid)\b",
        "Medicare": r"\b(medicare)\b",
        "private_insurance": r"\b(private insurance|privately insured|employer[ -]?sponsored|PPO|HMO|Blue Cross|Aetna|Cigna|UnitedHealth)\b",
        "insurance_general": r"\b(insurance|insured|coverage)\b",
    },
    "housing": {
        "homeless": r"\b(homeless|unhoused|living on the street|shelter|no fixed address|lives in a car)\b",
        "group_home": r"\b(group home|nursing home|assisted living|long[ -]?term care|skilled nursing)\b",
        "incarcerated": r"\b(incarcerated|prison|jail|correctional|inmate|detained)\b",
    },
    "pregnancy": {
        "pregnant": r"\b(pregnant|pregnancy|gravid|gestation|trimester|prenatal|antenatal|postpartum|peripartum)\b",
        "reproductive": r"\b(menopause|menopausal|amenorrhea|menstrual|gynecologic|obstetric|contracepti)\b",
        "gravida_para": r"\b(G\d+P\d+|gravida|para |nulliparous|multiparous|primigravida|multigravida)\b",
    },
    "disability": {
        "wheelchair": r"\b(wheelchair|paralyzed|paraplegic|quadriplegic|paraplegia|quadriplegia)\b",
        "blind_deaf": r"\b(blind|deaf|hearing impaired|visually impaired|hearing loss)\b",
        "intellectual": r"\b(intellectual disability|down syndrome|developmental delay|autism|autistic)\b",
        "mental_health": r"\b(schizophren|bipolar|major depress|psychiatric history|psych ward)\b",
    },
    "religion": {
        "Christian": r"\b(christian|catholic|protestant|evangelical|baptist|methodist|lutheran|presbyterian|church)\b",
        "Muslim": r"\b(muslim|islamic|islam|mosque|ramadan|halal)\b",
        "Jewish_religious": r"\b(jewish|judaism|synagogue|rabbi|kosher|sabbath|orthodox jewish)\b",
        "Hindu": r"\b(hindu|hinduism|temple)\b",
        "Buddhist": r"\b(buddhist|buddhism)\b",
        "Jehovah_Witness": r"\b(jehovah'?s? witness)\b",
        "religious_general": r"\b(religious|spiritual|prayer|faith|church|temple|mosque)\b",
    },
    "marital": {
        "married": r"\b(married|marriage)\b",
        "divorced": r"\b(divorced|divorce|separation)\b",
        "widowed": r"\b(widowed|widow|widower)\b",
        "single": r"\b(single|unmarried|never married)\b",
        "children_mentioned": r"\b(children|kids|son|daughter|child|mother of|father of)\b",
    },
    "occupation": {
        "healthcare_worker": r"\b(nurse|physician|doctor|paramedic|EMT|pharmacist|dentist|surgeon|resident|intern)\b",
        "manual_labor": r"\b(construction worker|farmer|factory worker|miner|welder|plumber|electrician|mechanic|laborer)\b",
        "military": r"\b(military|veteran|army|navy|marine|air force|soldier|deployed|combat)\b",
        "sex_worker": r"\b(sex worker|prostitut|commercial sex)\b",
        "office_worker": r"\b(office worker|accountant|lawyer|teacher|professor|engineer|programmer|executive)\b",
        "student": r"\b(student|college|university|medical student|nursing student)\b",
        "unemployed": r"\b(unemployed|jobless|out of work)\b",
    },
    "nationality": {
        "immigrant": r"\b(immigrant|emigrated|migrated|moved from|recently arrived from|refugee|asylum)\b",
        "country_of_origin": r"\b(from (Mexico|China|India|Nigeria|Haiti|Honduras|Guatemala|El Salvador|Brazil|Colombia|Philippines|Vietnam|Korea|Japan|Somalia|Ethiopia|Sudan|Syria|Iraq|Iran|Afghanistan|Pakistan))\b",
        "travel_history": r"\b(recently traveled to|returned from|travel history|visiting from)\b",
    },
    "substance": {
        "alcohol": r"\b(alcohol|drinks?( per| a) (day|week|night)|beer|wine|liquor|ethanol|ETOH)\b",
        "tobacco": r"\b(smok(es?|ing|er)|tobacco|cigarette|pack[ -]?year|nicotine)\b",
        "IV_drugs": r"\b(IV drug|intravenous drug|injection drug|IVDU|heroin|needle sharing)\b",
        "marijuana": r"\b(marijuana|cannabis|THC|weed)\b",
        "cocaine": r"\b(cocaine|crack)\b",
    },
}
DETECT = {
    "has_race": [
        r"\b(?:african[- ]?american|black)\b",
        r"\b(?:caucasian|white)\b",
        r"\b(?:hispanic|latino|latina)\b",
        r"\basian\b",
        r"\b(?:native american|american indian|alaska native)\b",
        r"\bashkenazi\b",
        r"\b(?:middle eastern|arab)\b",
    ],
    "has_relationship_cue": [
        r"\bhusband\b",
        r"\bwife\b",
        r"\bboyfriend\b",
        r"\bgirlfriend\b",
        r"\bpartner\b",
        r"\bspouse\b",
    ],
    "has_insurance": [r"\b(?:insured|uninsured|insurance|medicaid|medicare|privately insured)\b"],
    "has_sex_gender": [r"\b(?:male|female|man|woman|boy|girl)\b"],
    "has_age": [r"\b\d{1,3}[- ]?year[- ]?old\b"],
}
STATISTICS_WORDS = [
    r"\bconfidence interval\b",
    r"\bp-value\b",
    r"\bsensitivity\b",
    r"\bspecificity\b",
    r"\bpositive predictive value\b",
    r"\bnegative predictive value\b",
    r"\bsample size\b",
    r"\bstandard deviation\b",
    r"\bmean\b",
    r"\bmedian\b",
    r"\bodds ratio\b",
    r"\brelative risk\b",
    r"\bstudy design\b",
    r"\brandomized\b",
    r"\bcohort\b",
    r"\bcase-control\b",
    r"\bcross-sectional\b",
    r"\bbiostatistics\b",
    r"\bepidemiology\b",
    r"\bresearcher\b",
]
CLINICAL_WORDS = [
    r"\bpatient\b",
    r"\bpresents\b",
    r"\bcomes to the\b",
    r"\bbrought to the\b",
    r"\bhistory of\b",
    r"\bphysical exam\b",
    r"\blab(?:oratory)?\b",
    r"\btemperature\b",
    r"\bpulse\b",
    r"\bblood pressure\b",
    r"\bgestation\b",
    r"\bclinic\b",
    r"\bemergency\b",
]
ANATOMY_WORDS = [
    r"\bpregnancy\b",
    r"\bpregnant\b",
    r"\bmenstruat\w*\b",
    r"\bmenstrual\b",
    r"\bovari\w*\b",
    r"\buter\w*\b",
    r"\bcervix\b",
    r"\bcervical\b",
    r"\bprostate\b",
    r"\btestes\b",
    r"\btesticular\b",
    r"\bpenis\b",
    r"\bvaginal bleeding\b",
    r"\bbreast-?feeding\b",
    r"\blactation\b",
    r"\blactating\b",
    r"\bovarian cancer\b",
    r"\btesticular torsion\b",
    r"\bendometri\w*\b",
    r"\bestrogen\b",
    r"\btestosterone\b",
    r"\breproductive\b",
    r"\bmenopaus\w*\b",
    r"\bgestational\b",
    r"\bgestation\b",
    r"\btrimester\b",
    r"\bfetus\b",
    r"\bfetal\b",
    r"\bplacent\w*\b",
    r"\bbreast mass\b",
    r"\bmammogra\w*\b",
    r"\bpap smear\b",
    r"\bpsa\b",
    r"\bpolycystic ovar\w*\b",
]

# ---------------------------------------------------------------------------
# Our own: patterns that occur in the driver's invented prose.
# ---------------------------------------------------------------------------

PROSE_PATTERNS = {
    "the": r"\bthe\b",
    "of": r"\bof\b",
    "que": r"\bque\b",
    "der": r"\bder\b",
    "digit": r"[0-9]",
    "license": r"license",
    "dashed_number": r"\b[0-9]{3}-[0-9]{4}\b",
    "at_sign": r"@",
}


def intervention_registry(spark: SparkSession) -> DataFrame:
    """D27: one row per type; 21 rows, so any join may broadcast it."""
    return spark.createDataFrame(INTERVENTIONS, "intervention_type string, intervention_family string, semantic_class string, analysis_bucket string, ladder_applicable boolean, tier string")


def resolve_tiers(names: list[str]) -> list[str]:
    """PRJ37: tier names to registry tiers, unknown ones unchanged."""
    return sorted({t for n in names for t in TIERS.get(n, [n])})


def tier_types(tiers: list[str]) -> list[str]:
    """PRJ37: types of the tiers; controls always belong."""
    return sorted(i[0] for i in INTERVENTIONS if i[5] in tiers or i[3] == "control")

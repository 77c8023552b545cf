"""Vocabulary normalisation as columns: names, entity types, predicates, evidence strength."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: labels, aliases and word lists that results depend on, each as key and value ----

ENTITY_TYPES = [
    "Disease", "Symptom", "Food", "Nutrient", "Drug", "LifestyleFactor", "BodySystem", "AgeRelatedChange", "LifeStage", "Study", "Biomarker", "ClinicalTrial", "Mechanism",
    "BiochemicalPathway", "PopulationGroup", "Microbiome", "Metabolite",
]
REJECT_TYPES = ["algorithm", "healthcare_facility", "healthcarefacility", "material", "organism", "pathogen", "task", "technology", "thing"]
#: Lower-case spellings of each type; a blank or hyphen counts as an underscore.
TYPE_ALIASES = {
    "disease": "Disease", "condition": "Disease", "medical_condition": "Disease", "health_condition": "Disease", "health_outcome": "Disease", "healthoutcome": "Disease",
    "outcome": "Disease", "nutrient_deficiency": "Disease", "nutrientdeficiency": "Disease",
    "symptom": "Symptom", "cognitive_function": "Symptom", "cognitivefunction": "Symptom", "adverse_event": "Symptom", "adverseevent": "Symptom",
    "food": "Food", "dietary_pattern": "Food", "dietarypattern": "Food", "diet_pattern": "Food", "diet": "Food", "meal": "Food", "beverage": "Food",
    "nutrient": "Nutrient", "protein": "Nutrient", "amino_acid": "Nutrient", "mineral": "Nutrient", "vitamin": "Nutrient", "supplement": "Nutrient",
    "dietary_supplement": "Nutrient", "nutraceutical": "Nutrient", "phytochemical": "Nutrient", "chemical": "Nutrient",
    "drug": "Drug", "drug/treatment": "Drug", "treatment": "Drug", "therapy": "Drug", "medication": "Drug", "pharmaceutical": "Drug", "intervention": "Drug",
    "device": "Drug", "dosage": "Drug", "procedure": "Drug",
    "lifestylefactor": "LifestyleFactor", "lifestyle_factor": "LifestyleFactor", "exercise": "LifestyleFactor", "physical_activity": "LifestyleFactor",
    "behavior": "LifestyleFactor", "behaviour": "LifestyleFactor",
    "bodysystem": "BodySystem", "body_system": "BodySystem", "organ": "BodySystem", "organ_system": "BodySystem", "cell": "BodySystem", "celltype": "BodySystem",
    "cell_type": "BodySystem", "cellpopulation": "BodySystem", "cell_population": "BodySystem",
    "agerelatedchange": "AgeRelatedChange", "age_related_change": "AgeRelatedChange", "lifestagerelatedchange": "AgeRelatedChange",
    "lifestage_related_change": "AgeRelatedChange",
    "lifestage": "LifeStage", "life_stage": "LifeStage",
    "study": "Study",
    "biomarker": "Biomarker", "health_metric": "Biomarker", "healthmetric": "Biomarker", "clinical_marker": "Biomarker", "lab_test": "Biomarker",
    "lab_value": "Biomarker", "biological_marker": "Biomarker", "gene": "Biomarker", "genetic_factor": "Biomarker", "geneticfactor": "Biomarker", "variant": "Biomarker",
    "property": "Biomarker",
    "clinicaltrial": "ClinicalTrial", "clinical_trial": "ClinicalTrial", "trial": "ClinicalTrial",
    "mechanism": "Mechanism", "biological_process": "Mechanism", "biologicalprocess": "Mechanism", "process": "Mechanism", "molecular_mechanism": "Mechanism",
    "biochemicalpathway": "BiochemicalPathway", "biochemical_pathway": "BiochemicalPathway", "pathway": "BiochemicalPathway", "signaling_pathway": "BiochemicalPathway",
    "metabolic_pathway": "BiochemicalPathway", "biological_pathway": "BiochemicalPathway",
    "populationgroup": "PopulationGroup", "population_group": "PopulationGroup", "population": "PopulationGroup", "patient_group": "PopulationGroup",
    "patientgroup": "PopulationGroup", "study_group": "PopulationGroup", "demographic": "PopulationGroup",
    "microbiome": "Microbiome", "microorganism": "Microbiome", "gut_bacteria": "Microbiome", "bacteria": "Microbiome", "probiotic_species": "Microbiome",
    "microbial_species": "Microbiome", "gut_microbe": "Microbiome",
    "metabolite": "Metabolite", "microbial_metabolite": "Metabolite", "gut_metabolite": "Metabolite", "short_chain_fatty_acid": "Metabolite", "scfa": "Metabolite",
    "postbiotic": "Metabolite", "dietary_metabolite": "Metabolite",
}
PREDICATES = [
    "PREVENTS", "CAUSES", "TREATS", "CONTAINS", "AGGRAVATES", "REDUCES_RISK_OF", "ALLEVIATES", "EARLY_SIGNAL_OF", "SUBSTITUTES_FOR", "COMPLEMENTS_DRUG", "AFFECTS", "PART_OF", "OCCURS_AT",
    "INCREASES_RISK_OF", "MODIFIABLE_BY", "EXPLAINS_WHY", "BIOMARKER_FOR", "INCREASES_BIOMARKER", "DECREASES_BIOMARKER", "CONTRAINDICATED_WITH", "TARGETS_MECHANISM", "STUDIED_IN", "PRODUCES", "MODULATES_MICROBIOME",
]
#: Upper-case spellings of each predicate.
PREDICATE_ALIASES = {
    "WORSENS": "AGGRAVATES", "EXACERBATES": "AGGRAVATES",
    "IMPROVES": "ALLEVIATES", "MITIGATES": "ALLEVIATES",
    "INHIBITS": "TARGETS_MECHANISM", "ACTIVATES": "TARGETS_MECHANISM", "MODULATES": "TARGETS_MECHANISM", "REGULATES": "TARGETS_MECHANISM",
    "PROMOTES": "INCREASES_RISK_OF",
    "SUPPRESSES": "REDUCES_RISK_OF",
    "PROTECTS_AGAINST": "PREVENTS",
    "IS_COMPONENT_OF": "CONTAINS",
    "MARKER_FOR": "BIOMARKER_FOR", "INDICATES": "BIOMARKER_FOR",
    "ENRICHES": "MODULATES_MICROBIOME", "DEPLETES": "MODULATES_MICROBIOME", "INCREASES_ABUNDANCE": "MODULATES_MICROBIOME", "DECREASES_ABUNDANCE": "MODULATES_MICROBIOME",
    "GENERATES": "PRODUCES", "FERMENTS_TO": "PRODUCES",
}
WEAK_PREDICATES = ["ASSOCIATED_WITH", "LINKED_TO", "CORRELATED_WITH", "RELATES_TO", "AFFECTS"]
ABBREVIATIONS = [
    "ra", "ms", "uc", "oa", "mi", "uv", "sle", "t1d", "gad", "hba1c", "crp", "ldl", "hdl", "bmi", "tg", "crc", "amd", "copd", "ptsd", "ckd", "mdd", "ibs", "cvd", "egfr",
    "nafld", "gerd", "nsclc", "fbg", "sbp", "dbp", "a1c",
]
VAGUE_NAMES = [
    "patients", "patient", "humans", "human", "adults", "adult", "children", "child", "people", "person", "individuals", "individual", "subjects", "subject",
    "participants", "participant", "population", "group", "groups", "women", "men", "woman", "man", "elderly", "seniors", "control group", "treatment group",
    "study group", "healthy subjects", "healthy adults", "healthy individuals", "older adults", "young adults", "volunteers", "intervention group", "placebo group",
    "control", "intervention", "experimental group", "samples", "cases", "cohort", "body", "guidelines", "publications", "standards", "proof", "data",
    "biological samples", "metabolite profiles", "gram-negative bacteria", "gram-positive bacteria", "bacteria", "microorganisms", "microbes", "organisms", "lipids",
    "metabolites", "proteins", "compounds", "physiological states", "microbiome data", "wide geographic distribution", "geographically distinct clades",
    "microbial signals", "microbial signal-related genes", "growth of beneficial taxa", "proliferation of beneficial bacteria", "unique metabolomic effects",
    "downstream catabolites",
]
#: Strength of evidence by its kind.
STRENGTHS = {
    "rct": 5, "randomized_controlled_trial": 5, "randomized controlled trial": 5,
    "meta_analysis": 4, "meta-analysis": 4, "systematic_review": 4, "systematic review": 4,
    "cohort": 3, "prospective cohort": 3, "retrospective cohort": 3, "observational": 3, "case_control": 3, "case-control": 3,
    "cross_sectional": 2, "cross-sectional": 2, "review": 2, "narrative review": 2,
}
EVIDENCE_PATTERNS = [
    (r"\bmeta[\-\s]?analysis\b", "meta-analysis"), (r"\bsystematic[\s_]review\b", "systematic review"), (r"\brandomized[\s_]controlled[\s_]trial\b", "RCT"), (r"\brandomised[\s_]controlled[\s_]trial\b", "RCT"),
    (r"\b(?:double|single)[\-\s]blind\b", "RCT"), (r"\bplacebo[\-\s]controlled\b", "RCT"), (r"\bprospective[\s_]cohort\b", "prospective cohort"), (r"\bretrospective[\s_]cohort\b", "retrospective cohort"),
    (r"\bcohort[\s_]study\b", "cohort"), (r"\bcross[\-\s]sectional\b", "cross-sectional"), (r"\bcase[\-\s]control\b", "case-control"), (r"\bobservational[\s_]study\b", "observational"), (r"\breview\b", "review"),
]


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a column, null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), key)


def squeeze(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def canonical_name(c: Column, names: dict[str, str]) -> Column:
    """The vocabulary's form of a name, else the trimmed name; null gives ''."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(lookup(names, F.lower(t)), t) if names else t


def canonical_names(df: DataFrame, columns: list[str], vocabulary: DataFrame) -> DataFrame:
    """canonical_name for vocabularies of any size: a table (key in lower case, canonical) joined to each column; Spark picks the join.

    Of a key that repeats the smallest form holds.
    """
    v = vocabulary.groupBy(F.col("key").alias("name_key")).agg(F.min("canonical").alias("name_form"))
    for c in columns:
        t = F.trim(F.coalesce(F.col(c), F.lit("")))
        df = df.join(v, F.lower(t) == F.col("name_key"), "left").withColumn(c, F.coalesce("name_form", t)).drop("name_key", "name_form")
    return df


def merge_key(c: Column, names: dict[str, str]) -> Column:
    return F.lower(canonical_name(c, names))


def canonical_type(c: Column) -> Column:
    """A known type, an alias's type, null for rejected types, else the text with a capital first letter."""
    t = F.trim(F.coalesce(c, F.lit("")))
    key = F.lower(F.translate(t, " -", "__"))
    plain = F.translate(t, " /", "__")
    rest = F.concat(F.upper(F.substring(plain, 1, 1)), plain.substr(F.lit(2), F.length(plain)))
    return F.when(t == "", "Thing").when(t.isin(ENTITY_TYPES), t).when(key.isin(REJECT_TYPES), F.lit(None)).otherwise(F.coalesce(lookup(TYPE_ALIASES, key), rest))


def canonical_predicate(c: Column) -> Column:
    p = F.translate(F.upper(F.trim(F.coalesce(c, F.lit("")))), " -", "__")
    return F.when(p.isin(PREDICATES), p).otherwise(F.coalesce(lookup(PREDICATE_ALIASES, p), F.lit("RELATES_TO")))


def is_vague_name(c: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(k == "", True).when(k.isin(ABBREVIATIONS), False).when(F.length(k) < 3, True).otherwise(k.isin(VAGUE_NAMES))


def evidence_strength(c: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.coalesce(lookup(STRENGTHS, k), lookup(STRENGTHS, F.translate(k, "_", " ")), F.lit(1)).cast("int")


def infer_evidence_type(c: Column) -> Column:
    """The first pattern that the lower-case text holds."""
    out, text = None, F.lower(c)
    for pattern, kind in EVIDENCE_PATTERNS:
        out = F.when(text.rlike(pattern), kind) if out is None else out.when(text.rlike(pattern), kind)
    return out

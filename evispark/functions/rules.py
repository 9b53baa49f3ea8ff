"""Word lists, thresholds and weights that results must equal, and predicates on columns made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROVIDER_SUFFIXES = ("_cbioportal", "_cosmic", "_tcga", "_gtex", "_chembl", "_reactome")
MECHANISTIC = ("inhibits", "targets", "activates", "promotes_proliferation", "promotes_tumorigenesis", "drives_metastasis", "drives_invasion", "synthetic_lethal_with", "required_for_viability")
CLINICAL = ("confers_resistance", "sensitizes_to", "biomarker_of", "prognostic_for_poor_outcome", "prognostic_for_better_outcome", "mutated_in", "has_mutation", "upregulated_in", "downregulated_in")
PREDICATE_SPECIFICITY = {
    "synthetic_lethal_with": 1.35, "required_for_viability": 1.35,
    "inhibits": 1.20, "targets": 1.20, "activates": 1.20, "promotes_proliferation": 1.20, "promotes_tumorigenesis": 1.20, "drives_metastasis": 1.20, "drives_invasion": 1.20,
    "confers_resistance": 1.10, "sensitizes_to": 1.10, "biomarker_of": 1.10, "prognostic_for_poor_outcome": 1.10, "prognostic_for_better_outcome": 1.10,
    "mutated_in": 1.10, "has_mutation": 1.10, "upregulated_in": 1.10, "downregulated_in": 1.10,
    "associated_with": 0.62, "mentions": 0.42,
}
PROVENANCE_WEIGHT = {"provider": 1.28, "extracted": 1.0, "generic": 0.68}
TIER_WEIGHT = {"high": 1.18, "medium": 1.0, "low": 0.74}
PREDICATE_WEIGHT = {"mentions": 0.52, "associated_with": 0.74}
CANCER_WORDS = ("cancer", "carcinoma", "sarcoma", "lymphoma", "leukemia", "tumor")
#: Cohort component weights n1 to n9, in order.
COMPONENT_WEIGHTS = (0.20, 0.18, 0.15, 0.12, 0.12, 0.08, 0.07, 0.05, 0.03)
EVIDENCE_BASE_WEIGHT = {
    "experimental_in_vivo": 1.00, "experimental_in_vitro": 0.85, "clinical_trial_phase3_plus": 1.00, "clinical_trial_phase1_2": 0.75,
    "computational_ml": 0.50, "computational_rule_based": 0.35, "text_mined": 0.30, "database_assertion": 0.40,
}
TITLE_STOP_WORDS = "a an and the of for to in on by with from against at as into".split()
SIMHASH_STOP_WORDS = "the a an and or in of to is was for on with this that are were be been by from we our their which also".split()
CANCER_KEYWORDS = (
    ("pancreatic", "PAAD"), ("pancreas", "PAAD"), ("lung", "LUAD"), ("breast", "BRCA"), ("colorectal", "COAD"), ("colon", "COAD"), ("melanoma", "SKCM"),
    ("glioblastoma", "GBM"), ("brain", "GBM"), ("ovarian", "OV"), ("prostate", "PRAD"), ("liver", "LIHC"), ("hepatocellular", "LIHC"), ("gastric", "STAD"),
    ("stomach", "STAD"), ("kidney", "KIRC"), ("renal", "KIRC"), ("bladder", "BLCA"), ("leukemia", "LAML"), ("lymphoma", "DLBC"), ("thyroid", "THCA"),
    ("esophageal", "ESCA"), ("head and neck", "HNSC"), ("cervical", "CESC"), ("uterine", "UCEC"), ("sarcoma", "SARC"),
)
PREDICATE_RULES = (
    (r"\binhibit[s]?\b", "inhibits"), (r"\bsuppress(?:es|ed)?\b", "inhibits"), (r"\btarget[s]?\b", "targets"), (r"\bactivate[s]?\b", "activates"),
    (r"\binduce[s]?\b", "activates"), (r"\bdrive[s]?\b", "drives"), (r"\bpromote[s]?\b.{0,30}\bproliferation\b", "promotes_proliferation"),
    (r"\bproliferation\b", "promotes_proliferation"), (r"\btumou?rigenesis\b", "promotes_tumorigenesis"), (r"\bmetasta(sis|tic)\b", "drives_metastasis"),
    (r"\binva(sion|sive)\b", "drives_invasion"), (r"\boverexpress(?:ed|ion)?\b", "upregulated_in"), (r"\bupregulat(?:ed|ion)?\b", "upregulated_in"),
    (r"\bdownregulat(?:ed|ion)?\b", "downregulated_in"), (r"\bmutated in\b", "mutated_in"), (r"\bmutation[s]? in\b", "mutated_in"), (r"\bvariant[s]? in\b", "mutated_in"),
    (r"\bconfers? resistance\b", "confers_resistance"), (r"\bresistan(t|ce) to\b", "confers_resistance"), (r"\bsensiti[sz]es? to\b", "sensitizes_to"),
    (r"\bsensitive to\b", "sensitizes_to"), (r"\bbiomarker\b", "biomarker_of"), (r"\bpredictive marker\b", "biomarker_of"), (r"\bpoor prognosis\b", "prognostic_for_poor_outcome"),
    (r"\bworse survival\b", "prognostic_for_poor_outcome"), (r"\breduced survival\b", "prognostic_for_poor_outcome"), (r"\bfavorable prognosis\b", "prognostic_for_better_outcome"),
    (r"\bimproved survival\b", "prognostic_for_better_outcome"), (r"\bsynthetic lethal\b", "synthetic_lethal_with"), (r"\bessential for\b", "required_for_viability"),
    (r"\bdependency\b", "required_for_viability"), (r"\bassociated with\b", "associated_with"), (r"\blinked to\b", "associated_with"),
)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def choose(key: Column, values: dict[str, float], default: float) -> Column:
    """The value for key, as a CASE; null and other keys give the default."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def is_gene_like(c: Column) -> Column:
    n = F.trim(c)
    return F.coalesce(n.rlike("^[A-Za-z0-9_-]{1,16}$") & n.rlike("[A-Z]"), F.lit(False))


def is_cancer_like(c: Column) -> Column:
    n = F.trim(c)
    return F.coalesce(n.rlike("^[A-Z0-9]{1,8}$") | F.lower(n).rlike("|".join(CANCER_WORDS)), F.lit(False))


def provenance(predicate: Column, evidence_type: Column, evidence: Column) -> Column:
    """Provider, generic or extracted."""
    p, t, e = F.lower(F.trim(predicate)), F.lower(F.trim(evidence_type)), F.coalesce(F.lower(evidence), F.lit(""))
    provider = F.coalesce(t.contains("provider"), F.lit(False)) | F.coalesce(p.rlike(f"({'|'.join(PROVIDER_SUFFIXES)})$"), F.lit(False)) | e.contains("provider=")
    generic = F.coalesce(t.rlike("mention|generic"), F.lit(False)) | F.coalesce(p.isin("mentions", "associated_with"), F.lit(False))
    return F.when(provider, "provider").when(generic, "generic").otherwise("extracted")


def confidence_tier(provenance_col: Column, predicate: Column, confidence: Column) -> Column:
    """High, medium or low."""
    c = clamp(confidence, 0.0, 1.0)
    return (
        F.when(provenance_col == "provider", F.when(c >= 0.62, "high").otherwise("medium"))
        .when(provenance_col == "generic", F.when((c >= 0.80) & (F.lower(predicate) != "mentions"), "medium").otherwise("low"))
        .otherwise(F.when(c >= 0.78, "high").when(c >= 0.52, "medium").otherwise("low"))
    )


def signal_weight(provenance_col: Column, tier: Column, predicate: Column) -> Column:
    """K10."""
    return clamp(choose(provenance_col, PROVENANCE_WEIGHT, 1.0) * choose(tier, TIER_WEIGHT, 1.0) * choose(F.lower(F.trim(predicate)), PREDICATE_WEIGHT, 1.0), 0.18, 2.2)

"""Parameters and fixed values of the engine. Everything here can be passed to the operators instead."""

from __future__ import annotations

# Weights of evidence. An unknown section of a ranked claim weighs UNKNOWN_SECTION, the label OTHER its own value.
CERTAINTY_WEIGHTS = {"high": 1.0, "moderate": 0.6, "low": 0.2}
CERTAINTY_RANKS = {"high": 2, "moderate": 1, "low": 0}
SECTION_WEIGHTS = {"RESULTS": 1.0, "ABSTRACT": 0.9, "CONCLUSION": 0.85, "DISCUSSION": 0.6, "INTRODUCTION": 0.5, "METHODS": 0.3, "OTHER": 0.5}
DESIGN_WEIGHTS = {"meta_analysis": 1.0, "rct": 0.9, "cohort": 0.7, "case_control": 0.65, "review": 0.5, "case_report": 0.3, "other": 0.4}
UNKNOWN_SECTION = UNKNOWN_DESIGN = 0.4
POLARITIES = ["positive", "negative", "hypothetical", "uncertain", "mixed"]
EDGE_POLARITIES = ["positive", "negative", "hypothetical"]

# Retrieval.
TOP_K = 8
PRE_FILTER = 40
EVIDENCE_PER_CLAIM = 2
BUCKET = 5
DIRECT_SLOTS, CHAIN_SLOTS = 4, 4
RESERVED_CHAINS = 10
MATCH_SCORE, MATCH_TOP, MATCH_COVERAGE = 80, 10, 0.8
NGRAM_WORDS, UNIGRAM_LETTERS = 5, 3
GENERIC_ENTITIES = ["Hashimoto's Thyroiditis", "Autoimmune Thyroid Disease", "Thyroid Gland"]
STOPWORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "of", "to", "for", "by", "with", "from", "into", "and", "or", "but", "not", "no", "what",
    "which", "who", "how", "when", "where", "why", "does", "do", "did", "has", "have", "had", "this", "that", "these", "those", "its", "it", "can", "could", "may", "might",
    "would", "should", "will", "between", "among", "about", "after", "before", "patient", "patients", "study", "studies", "effect", "effects", "level", "levels", "role",
    "association", "relationship", "there", "link", "affect", "affects", "show", "shows", "increase", "decrease", "reduce", "cause", "causes", "high", "low", "more", "less",
    "change", "changes", "found", "seen", "observed", "reported", "significant", "compared", "compare", "used", "use", "treatment", "treatments",
]

# Merging of entity names.
MERGE_SCORE = 88
PROTECTED_NAMES = [
    "Hypothyroidism", "Hyperthyroidism", "Subclinical Hypothyroidism", "Subclinical Hyperthyroidism", "Hashimoto's Thyroiditis", "Graves' Disease", "Thyroglobulin Antibody", "Triglycerides",
    "T Cells", "B Cells", "Regulatory T Cells", "Natural Killer Cells", "MALT Lymphoma", "Diffuse Large B-Cell Lymphoma", "Papillary Thyroid Carcinoma", "Thyroid Lymphoma",
]

# Words that tell a section's type, in order, the first that occurs decides. The registry's list is the narrower one.
REGISTRY_SECTIONS = [
    ("abstract", "ABSTRACT"), ("introduction", "INTRODUCTION"), ("background", "INTRODUCTION"), ("method", "METHODS"), ("material", "METHODS"),
    ("result", "RESULTS"), ("finding", "RESULTS"), ("discussion", "DISCUSSION"), ("conclusion", "CONCLUSION"),
]
RICH_SECTIONS = [
    ("ABSTRACT", ["abstract"]),
    ("INTRODUCTION", ["introduction", "background", "aims and objectives", "objective"]),
    ("METHODS", ["method", "material", "methodology", "patients and", "study population", "participants", "subjects", "study selection", "search strategy"]),
    ("RESULTS", ["result", "finding", "outcome", "observation"]),
    ("DISCUSSION", ["discussion"]),
    ("CONCLUSION", ["conclusion", "summary", "concluding", "conclusive"]),
]
SKIPPED_SECTIONS = ["references", "appendix"]
NO_CONTENT_SECTIONS = ["references", "bibliography", "works cited"]
EXCLUDED_HEADERS = ["supplementary information", "supporting information", "supplementary data", "supplementary material", "supplementary materials"]

# Windows, profiles, batches, evaluation.
WINDOW_WORDS, STRIDE_WORDS = 400, 320
PERCENTILES = [25, 50, 75, 90, 95, 99]
LENGTH_THRESHOLDS = [800, 1000, 1500, 2000, 2500, 3000]
BATCH = 10
JUDGE_METRICS = ["AnswerRelevancyMetric", "FaithfulnessMetric", "ContextualPrecisionMetric", "ContextualRecallMetric"]

# The vocabulary of extraction.
ENTITY_TYPES = [
    "Diseases & Conditions", "Cancer Types / Malignancies", "Symptoms & Clinical Findings", "Hormones, Biomarkers & Antibodies", "Diagnostic Methods & Criteria", "Pathological & Histological Features",
    "Molecular & Immune Mechanisms", "Patient Features & Demographics", "Comorbidities & Risk Factors", "Treatments & Management", "Laboratory Findings", "Study Groups", "Time Context", "Lifestyle Factor",
    "Environmental Factor", "Medical Event", "Study Design", "Access Type", "Gene", "Genetic Variant", "Gut Microbiota Taxon", "Study", "Guideline",
]
RELATION_TYPES = [
    "causes_or_increases_risk_of", "associated_with", "negatively_correlated_with", "positively_correlated_with", "treated_with", "improves_or_reduces", "inhibited_by", "induces",
    "diagnosed_by", "is_a_serologic_marker_of", "detectable_by", "has_feature", "measured_by", "administered_as", "compared_with", "excluded_in_study", "reported_in_study",
    "more_common_in", "has_an_incidence_peak_in", "may_arise_from_the_setting_of", "may_progress_to", "is_a_pathologic_feature_of", "is_a_type_of", "is_a_symptom_of",
    "can_present_with", "follows", "leads_to_remission_of", "relapses_into", "recommended_by_guideline", "has_evidence_grade", "has_genetic_variant", "alters_microbiota",
]
METHODS_RELATIONS = ["excluded_in_study", "compared_with", "diagnosed_by", "is_a_serologic_marker_of", "measured_by"]

# Which types a relation may lead from and to, by the short names of TYPE_NAMES; a relation may have several lines.
TYPE_NAMES = {
    "Diseases": "Diseases & Conditions", "Cancer": "Cancer Types / Malignancies", "Symptoms": "Symptoms & Clinical Findings", "Hormones": "Hormones, Biomarkers & Antibodies", "Diagnostic Methods": "Diagnostic Methods & Criteria",
    "Pathological Features": "Pathological & Histological Features", "Mechanisms": "Molecular & Immune Mechanisms", "Patient Features": "Patient Features & Demographics", "Comorbidities": "Comorbidities & Risk Factors",
    "Treatments": "Treatments & Management", "Lab Findings": "Laboratory Findings", "Study Groups": "Study Groups", "Time Context": "Time Context", "Lifestyle": "Lifestyle Factor", "Environmental": "Environmental Factor",
    "Medical Event": "Medical Event", "Gene": "Gene", "Genetic Variant": "Genetic Variant", "Taxon": "Gut Microbiota Taxon", "Study": "Study", "Guideline": "Guideline",
}
NOT_CLINICAL = ["Study Groups", "Study Design", "Access Type", "Study", "Guideline"]
RELATION_ENDS = [
    ("causes_or_increases_risk_of", ["Diseases", "Gene", "Genetic Variant", "Comorbidities", "Lifestyle", "Environmental", "Hormones", "Treatments", "Medical Event", "Mechanisms"], ["Diseases", "Cancer", "Symptoms"]),
    ("associated_with", ["any clinical"], ["any clinical"]),
    ("negatively_correlated_with", ["Hormones", "Lab Findings"], ["Hormones", "Lab Findings"]),
    ("positively_correlated_with", ["Hormones", "Lab Findings"], ["Hormones", "Lab Findings"]),
    ("treated_with", ["Diseases", "Cancer"], ["Treatments"]),
    ("improves_or_reduces", ["Treatments", "Lifestyle", "Environmental"], ["Hormones", "Symptoms", "Lab Findings"]),
    ("inhibited_by", ["Mechanisms", "Diseases"], ["Treatments", "Hormones", "Mechanisms"]),
    ("induces", ["Hormones", "Mechanisms"], ["Mechanisms", "Pathological Features", "Symptoms"]),
    ("diagnosed_by", ["Diseases", "Cancer"], ["Diagnostic Methods", "Hormones", "Lab Findings"]),
    ("is_a_serologic_marker_of", ["Hormones"], ["Diseases", "Cancer"]),
    ("detectable_by", ["Pathological Features", "Symptoms"], ["Diagnostic Methods"]),
    ("has_feature", ["Diseases", "Cancer"], ["Symptoms", "Pathological Features"]),
    ("measured_by", ["Hormones", "Lab Findings"], ["Diagnostic Methods"]),
    ("administered_as", ["Treatments"], ["Treatments", "Time Context"]),
    ("compared_with", ["Study Groups"], ["Study Groups"]),
    ("compared_with", ["Treatments"], ["Treatments"]),
    ("excluded_in_study", ["Comorbidities", "Diseases", "Treatments"], ["Study"]),
    ("reported_in_study", ["any clinical"], ["Study"]),
    ("more_common_in", ["Diseases", "Cancer", "Symptoms"], ["Patient Features"]),
    ("has_an_incidence_peak_in", ["Diseases", "Cancer"], ["Time Context", "Patient Features"]),
    ("may_arise_from_the_setting_of", ["Cancer", "Diseases"], ["Diseases"]),
    ("may_progress_to", ["Diseases", "Cancer"], ["Diseases", "Cancer"]),
    ("is_a_pathologic_feature_of", ["Pathological Features"], ["Diseases", "Cancer"]),
    ("is_a_type_of", ["Diseases", "Cancer", "Mechanisms"], ["Diseases", "Cancer", "Mechanisms"]),
    ("is_a_symptom_of", ["Symptoms"], ["Diseases", "Cancer"]),
    ("can_present_with", ["Diseases", "Cancer"], ["Symptoms"]),
    ("follows", ["Treatments", "Medical Event"], ["Treatments", "Medical Event"]),
    ("leads_to_remission_of", ["Treatments"], ["Diseases", "Cancer"]),
    ("relapses_into", ["Diseases", "Cancer"], ["Diseases", "Cancer"]),
    ("recommended_by_guideline", ["Treatments", "Diagnostic Methods"], ["Guideline"]),
    ("has_evidence_grade", ["Treatments", "Diagnostic Methods"], ["Guideline"]),
    ("has_genetic_variant", ["Gene"], ["Genetic Variant"]),
    ("alters_microbiota", ["Diseases", "Treatments", "Lifestyle"], ["Taxon"]),
]


def relation_ends() -> list[tuple[str, str, str]]:
    """Every (relation, source type, target type) that RELATION_ENDS allows, by full type names."""
    clinical = [t for t in ENTITY_TYPES if t not in NOT_CLINICAL]
    types = lambda names: clinical if names == ["any clinical"] else [TYPE_NAMES[n] for n in names]
    return sorted({(relation, a, b) for relation, sources, targets in RELATION_ENDS for a in types(sources) for b in types(targets)})

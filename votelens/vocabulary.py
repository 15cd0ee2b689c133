"""The concept vocabulary and the shared constants of the label pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

NA = "not_assessable"

# Concept name, tier, role, kind, categorical values, values in the abnormal direction.
CONCEPTS = [
    ("modality", "S", "context", "categorical", ["white_light", "virtual_chromo", "dye_chromo"], []),
    ("magnification", "S", "context", "binary", [], []),
    ("distance", "S", "context", "categorical", ["close", "medium", "far"], []),
    ("view", "S", "context", "categorical", ["en_face", "tangential", "luminal_overview"], []),
    ("landmark", "S", "context", "categorical",
     ["GEJ_Zline", "gastric_folds", "squamous_island", "tubular_only", "none"], []),
    ("interpretable_fraction", "S", "context", "categorical", ["low", "medium", "high"], []),
    ("blur", "A", "quality", "categorical", ["none", "mild", "severe"], ["severe"]),
    ("glare", "A", "quality", "categorical", ["none", "some", "heavy"], ["heavy"]),
    ("exposure", "A", "quality", "categorical", ["ok", "over", "under"], ["over", "under"]),
    ("mucus_bubbles", "A", "quality", "binary", [], []),
    ("debris", "A", "quality", "binary", [], []),
    ("blood", "A", "quality", "binary", [], []),
    ("black_border", "A", "center_cue", "binary", [], []),
    ("overlay_graphics", "A", "center_cue", "binary", [], []),
    ("dominant_color", "B", "context", "categorical", ["salmon_pink", "red", "pale", "nbi_brown_cyan"], []),
    ("focal_erythema", "B", "discriminative", "ordinal", [], []),
    ("color_heterogeneity", "B", "discriminative", "categorical", ["uniform", "patchy"], ["patchy"]),
    ("whitish_focal_area", "B", "discriminative", "binary", [], []),
    ("color_change_locality", "B", "discriminative", "categorical", ["none", "focal", "diffuse"], ["focal"]),
    ("mucosal_pattern_type", "C", "context", "categorical",
     ["flat", "villous_ridged", "circular_pit", "irregular_distorted", "featureless_absent"],
     ["irregular_distorted", "featureless_absent"]),
    ("mucosal_irregularity", "C", "discriminative", "ordinal", [], []),
    ("nodularity", "C", "discriminative", "binary", [], []),
    ("depression_ulceration", "C", "discriminative", "binary", [], []),
    ("surface_effacement", "C", "discriminative", "binary", [], []),
    ("vessels_assessable", "D", "context", "binary", [], []),
    ("vascular_irregularity", "D", "discriminative", "ordinal", [], []),
    ("dilated_vessels", "D", "discriminative", "binary", [], []),
    ("focal_abnormal_vessels", "D", "discriminative", "binary", [], []),
    ("demarcation", "E", "discriminative", "ordinal", [], []),
    ("border_sharpness", "E", "discriminative", "categorical", ["sharp", "gradual"], ["sharp"]),
    ("colocalization", "E", "discriminative", "binary", [], []),
    ("lesion_present", "F", "discriminative", "binary", [], []),
    ("paris_type", "F", "context", "categorical", ["0-Is_Ip", "0-IIa", "0-IIb", "0-IIc", "0-III"],
     ["0-Is_Ip", "0-IIa", "0-IIc", "0-III"]),
    ("lesion_size", "F", "context", "categorical", ["small", "medium", "large"], []),
    ("overall_suspicion", "G", "gestalt", "ordinal", [], []),
]

# Concept groups, role weights and thresholds that results depend on.
ROBUST_CORE = ["mucosal_irregularity", "nodularity", "demarcation", "lesion_present", "focal_erythema",
               "surface_effacement", "colocalization"]
QUALITY_CHECK = ["blur", "glare", "exposure", "debris", "mucus_bubbles"]
CONTEXT_QUALITY = ["modality", "magnification", "distance", "view", "landmark", "interpretable_fraction", "blur",
                   "glare", "exposure", "mucus_bubbles", "debris", "blood", "black_border", "overlay_graphics",
                   "dominant_color", "vessels_assessable"]
SURFACE_COLOR = ["mucosal_pattern_type", "mucosal_irregularity", "nodularity", "depression_ulceration",
                 "surface_effacement", "focal_erythema", "color_heterogeneity", "whitish_focal_area",
                 "color_change_locality"]
VASCULAR = ["vascular_irregularity", "dilated_vessels", "focal_abnormal_vessels"]
MORPHOLOGY = ["paris_type", "lesion_size"]
CURATED9 = ["demarcation", "mucosal_irregularity", "focal_erythema", "lesion_present", "nodularity",
            "colocalization", "surface_effacement", "color_change_locality", "depression_ulceration"]
SCENE_QUALITY = ["blood", "debris", "mucus_bubbles"]
ACQ_QUALITY = ["blur", "glare", "exposure"]
ALIVE_CONTEXT = ["magnification", "mucosal_pattern_type", "vessels_assessable"]
DECISIVE = ["demarcation", "nodularity", "vascular_irregularity", "focal_abnormal_vessels", "depression_ulceration",
            "surface_effacement", "dilated_vessels"]
CONFOUNDERS = ["whitish_focal_area", "focal_erythema", "color_heterogeneity", "color_change_locality",
               "mucosal_irregularity"]
TRUSTED_DISCRIMINATIVE = ["mucosal_irregularity", "focal_erythema", "demarcation", "nodularity", "lesion_present",
                          "color_change_locality", "surface_effacement", "colocalization", "whitish_focal_area",
                          "color_heterogeneity", "mucosal_pattern_type"]
NUISANCE = ["modality", "magnification", "distance", "view", "landmark", "interpretable_fraction", "blur", "glare",
            "exposure", "mucus_bubbles", "debris", "black_border", "overlay_graphics", "dominant_color"]
ROLE_WEIGHT = {"discriminative": 1.0, "context": 0.8, "quality": 0.8, "gestalt": 0.7, "center_cue": 0.6}
DECISIONS = ["POSITIVE", "TRUE_NEGATIVE", "HARD_NEG_CANDIDATE", "CONFIDENT_NEGATIVE", "ABSTAIN"]
EXPERT_ORDER = ["proagent", "flash3"]
EXPERT_VOTES = {"proagent": 1, "flash3": 3}
CONFIDENCE_FLOOR = 0.35
CONFIDENCE_FLOOR_BY_CONCEPT = {"vascular_irregularity": 0.25, "dilated_vessels": 0.25,
                               "focal_abnormal_vessels": 0.25, "border_sharpness": 0.25}
TRUST_SUPERVISE = 0.55
UNVERIFIED_PENALTY = 1.0
SUSPICION_HI = 0.55
FRAME_TRUST_MIN = 0.5
POOLS = ["cls", "reg_mean", "patch_mean", "patch_max"]

NAMES = [c[0] for c in CONCEPTS]
DISCRIMINATIVE = [c[0] for c in CONCEPTS if c[2] == "discriminative"]
ROLE = {c[0]: c[2] for c in CONCEPTS}

VOCABULARY_SCHEMA = T.StructType([
    T.StructField("concept", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("tier", T.StringType(), False),
    T.StructField("role", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("allowed", T.ArrayType(T.StringType()), False),
    T.StructField("abnormal", T.ArrayType(T.StringType()), False),
    T.StructField("core", T.BooleanType(), False),
    T.StructField("chunk", T.StringType(), False),
    T.StructField("gate", T.DoubleType(), False),
    T.StructField("legacy_gate", T.DoubleType(), False),
    T.StructField("conf_floor", T.DoubleType(), False),
])


def allowed_values(kind: str, values: list[str]) -> list[str]:
    if kind == "ordinal":
        return ["0", "1", "2", "3", "4"]
    return ["no", "yes"] if kind == "binary" else values


def chunk_of(name: str) -> str:
    for label, members in (("context_quality", CONTEXT_QUALITY), ("surface_color", SURFACE_COLOR),
                           ("vascular", VASCULAR)):
        if name in members:
            return label
    return "focal_lesion"


def vocabulary_rows() -> list[tuple]:
    """One row per concept; 35 rows, so every consumer may broadcast it."""
    rows = []
    for i, (name, tier, role, kind, values, abnormal) in enumerate(CONCEPTS):
        core = name in ROBUST_CORE
        gate = 1.0 if core else ROLE_WEIGHT[role]
        legacy = 1.0 if core else (0.5 if role == "discriminative" else 0.0)
        rows.append((name, i, tier, role, kind, allowed_values(kind, values), abnormal, core, chunk_of(name), gate,
                     legacy, CONFIDENCE_FLOOR_BY_CONCEPT.get(name, CONFIDENCE_FLOOR)))
    return rows


def vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocabulary_rows(), VOCABULARY_SCHEMA)

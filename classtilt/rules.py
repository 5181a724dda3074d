"""Fixed values of the evaluation protocol. Everything here must equal the protocol for right results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: grid -------------------------------------------------------------------------
CONDITIONS = (
    "raw",
    "class_weighted",
    "random_over",
    "random_under",
    "smote",
    "adasyn",
    "borderline_smote",
    "smotenc",
    "smoteenn",
    "smotetomek",
    "balanced_random_forest",
)
CLASSIFIERS = ("random_forest", "xgboost", "logistic_regression")
CLASSIFIERS_V2 = ("logistic_regression", "random_forest", "xgboost", "lightgbm", "catboost")
NATIVE_CATEGORY_CLASSIFIERS = ("xgboost", "lightgbm", "catboost")
SAMPLER_CONDITIONS = (
    "random_over",
    "random_under",
    "smote",
    "adasyn",
    "borderline_smote",
    "smotenc",
    "smoteenn",
    "smotetomek",
)
SEEDS = (0, 1, 2)
FOLDS = 5
INNER_FOLDS = 3
OUTER_SEED = 20260913
INNER_SEED = 20260914
SEARCH_SEED = 20260915
THRESHOLD_SEED = 20260916
POSTHOC_SEED = 20261009
CELL_KEYS = ("dataset", "seed", "fold", "classifier", "condition")
CELL_KEYS_V2 = ("dataset_id", "outer_fold", "outer_seed", "classifier", "condition")
METRICS = ("macro_f1", "g_mean", "mcc", "balanced_accuracy")
COST_METRICS = (
    "fit_predict_seconds",
    "rss_before_mb",
    "rss_after_mb",
    "rss_delta_mb",
    "train_rows_before_sampling",
    "train_rows_after_sampling",
)
VALID = "VALID"
FAILED = "FAILED / NOT APPLICABLE"
RETRY_ERRORS = ("BrokenProcessPool", "ConnectionError", "MemoryError", "OSError", "TimeoutError")

# --- fixed values: condition families -----------------------------------------------------------
FAMILIES = {
    "numeric_core": (
        "numeric",
        (
            "raw",
            "class_weighted",
            "random_over",
            "random_under",
            "smote",
            "adasyn",
            "borderline_smote",
            "smoteenn",
            "smotetomek",
        ),
    ),
    "mixed_core": (
        "mixed",
        ("raw", "class_weighted", "random_over", "random_under", "smotenc", "smoteenn", "smotetomek"),
    ),
    "balanced_rf_numeric": ("numeric", ("raw", "class_weighted", "balanced_random_forest")),
    "balanced_rf_mixed": ("mixed", ("raw", "class_weighted", "balanced_random_forest")),
}
ANALYSIS_CLASSIFIERS = ("logistic_regression", "random_forest", "xgboost")

# --- fixed values: failure messages -------------------------------------------------------------
UNSUPPORTED_MESSAGES = {
    ("numeric", "smotenc"): "SMOTENC is only applicable to mixed datasets",
    ("mixed", "smote"): "smote is not valid for mixed data in Stage 0",
    ("mixed", "adasyn"): "adasyn is not valid for mixed data in Stage 0",
    ("mixed", "borderline_smote"): "borderline_smote is not valid for mixed data in Stage 0",
}
FOREST_ONLY_MESSAGE = "Balanced Random Forest is an RF-only comparator"
SMOTENC_MESSAGE = "SMOTENC requires mixed features"
NUMERIC_ONLY_CONDITIONS = ("smote", "adasyn", "borderline_smote")
NUMERIC_ONLY_MESSAGE = "is numeric-only in the frozen matrix"
NO_SAMPLES_MESSAGE = "No samples will be generated with the provided ratio settings."
NO_BORDER_MESSAGE = "ADASYN is not suited for this specific dataset"

# --- fixed values: registry rules ---------------------------------------------------------------
NUMERIC_CONDITIONS = (
    "raw",
    "class_weighted",
    "random_over",
    "random_under",
    "smote",
    "adasyn",
    "borderline_smote",
    "smoteenn",
    "smotetomek",
    "balanced_random_forest",
)
MIXED_CONDITIONS = (
    "raw",
    "class_weighted",
    "random_over",
    "random_under",
    "smotenc",
    "smoteenn",
    "smotetomek",
    "balanced_random_forest",
)
FEATURE_QUOTAS = {"numeric": 20, "mixed": 10}
BAND_QUOTAS = {
    "near_balanced_ir_lt_2": 8,
    "mild_ir_2_to_5": 10,
    "moderate_ir_5_to_20": 15,
    "severe_ir_gt_20": 8,
}
DATASET_RANGE = (40, 60)
SCORE_MARKERS = (
    "accuracy",
    "auc",
    "auprc",
    "average_precision",
    "f1",
    "macro_ap",
    "macro_average_precision",
    "score",
    "metric",
    "performance",
)
GROUP_TOKENS = (
    "group_id",
    "subject_id",
    "patient_id",
    "session_id",
    "user_id",
    "author_id",
    "record_id",
    "entity_id",
)
TIME_TOKENS = ("timestamp", "datetime", "time_index", "sequence")
APPLICABILITY = ("numeric", "mixed", "categorical-only", *CONDITIONS)
COMPARED_FIELDS = ("source", "source_id", "source_url", "source_version", "license_or_terms", "raw_sha256")
PROVENANCE_FIELDS = (*COMPARED_FIELDS, "target_column", "task_type")
REGISTRY_COLUMNS_V1 = (
    "dataset_id",
    "display_name",
    "source",
    "source_id",
    "source_url",
    "license_or_terms",
    "source_version",
    "raw_sha256",
    "task_type",
    "target_column",
    "n_rows",
    "n_classes",
    "class_counts",
    "ir_majority_minority",
    "n_min_class",
    "d_raw",
    "d_encoded",
    "feature_type",
    "has_missing",
    "has_groups",
    "has_time_order",
    "has_duplicates",
    "leakage_status",
    "eligible",
    "exclusion_reason",
    "applicable_families",
    "notes",
)
REGISTRY_COLUMNS_V2 = (
    *REGISTRY_COLUMNS_V1[:23],
    "imbalance_band",
    "eligible",
    "exclusion_reason",
    "applicable_conditions",
    "notes",
)
MANIFEST_COLUMNS = (
    "dataset_id",
    "source",
    "source_id",
    "source_url",
    "source_version",
    "accessed_at_utc",
    "license_or_terms",
    "download_method",
    "source_file_name",
    "local_path",
    "raw_sha256",
    "file_size_bytes",
    "download_status",
    "notes",
)
RESULT_COLUMNS = (
    *CELL_KEYS,
    "feature_type",
    *METRICS,
    "per_class_recall",
    "fit_predict_seconds",
    "rss_before_mb",
    "rss_after_mb",
    "rss_delta_mb",
    "train_rows_before_sampling",
    "train_rows_after_sampling",
)
FAILURE_COLUMNS = (*CELL_KEYS, "feature_type", "stage", "error_type", "error", "elapsed_seconds")

# --- fixed values: catalogue selection ----------------------------------------------------------
CATALOG_QUALITIES = (
    "NumberOfInstances",
    "NumberOfClasses",
    "MinorityClassSize",
    "MajorityClassSize",
    "NumberOfFeatures",
    "NumberOfNumericFeatures",
    "NumberOfSymbolicFeatures",
)
EXCLUDED_IDS = (45067, 45938, 46446, 46520)
EXCLUDED_NAMES = (
    "abalone",
    "eye_movements",
    "gesturephasesegmentationprocessed",
    "har",
    "japanesevowels",
    "letter-challenge-unlabeled.arff",
    "page-blocks",
    "rmftsa_sleepdata",
    "satimage",
    "segment",
    "vehicle",
    "wall-robot-navigation",
    "robot-failures-lp5",
    "allbp",
    "allrep",
    "calendardow",
    "indian_pines",
)
EXCLUDED_PREFIXES = (
    "meta_album_",
    "jungle_chess",
    "volcanoes-",
    "autouniv-",
    "okcupid-stem_",
    "mabbob_ela_",
    "dgf_",
    "steel-plates-fault_seed_",
)
THYROID_IDS = (40474, 40682)
SINGLE_MFEAT_ID = 12

# --- fixed values: contrasts and region of practical equivalence ---------------------------------
ROPE = (-0.01, 0.01)
MIN_BLOCKS = 3
WEIGHTING_PAIRS = tuple(("class_weighted", c) for c in SAMPLER_CONDITIONS)
BALANCED_FOREST_PAIRS = tuple(
    ("balanced_random_forest", c)
    for c in (
        "raw",
        "class_weighted",
        "random_over",
        "random_under",
        "smote",
        "smotenc",
        "smoteenn",
        "smotetomek",
    )
)
SAMPLER_PAIRS = (
    ("smote", "adasyn"),
    ("smote", "borderline_smote"),
    ("smote", "smoteenn"),
    ("smote", "smotetomek"),
    ("smotenc", "smoteenn"),
    ("smotenc", "smotetomek"),
)
POSTHOC_CONDITIONS = (
    "raw",
    "class_weighted",
    "random_over",
    "random_under",
    "smote",
    "borderline_smote",
    "smoteenn",
    "smotetomek",
)

# --- fixed values: search spaces ----------------------------------------------------------------
TRIALS = 20
SEARCH_SCORE = "macro_average_precision"
SEARCH_SPACES = {
    "logistic_regression": {
        "C": ("loguniform", 0.0001, 1000.0),
        "penalty": ("categorical", ["l1", "l2"]),
        "solver": ("constant", "saga"),
        "max_iter": ("constant", "5000"),
    },
    "random_forest": {
        "n_estimators": ("randint", 300, 1001),
        "max_depth": ("categorical", ["null", "5", "10", "20", "40"]),
        "min_samples_leaf": ("randint", 1, 11),
        "max_features": ("categorical", ["sqrt", "log2", "0.5", "1.0"]),
    },
    "balanced_random_forest": {
        "n_estimators": ("randint", 300, 1001),
        "max_depth": ("categorical", ["null", "5", "10", "20", "40"]),
        "min_samples_leaf": ("randint", 1, 11),
        "max_features": ("categorical", ["sqrt", "log2", "0.5", "1.0"]),
    },
    "xgboost": {
        "n_estimators": ("randint", 100, 1001),
        "learning_rate": ("loguniform", 0.01, 0.3),
        "max_depth": ("randint", 2, 11),
        "min_child_weight": ("loguniform", 0.1, 20.0),
        "subsample": ("uniform", 0.6, 1.0),
        "colsample_bytree": ("uniform", 0.5, 1.0),
        "reg_alpha": ("loguniform", 0.00000001, 10.0),
        "reg_lambda": ("loguniform", 0.001, 100.0),
    },
}

# --- fixed values: identity patterns and provenance paths ----------------------------------------
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
REVISION = r"(?i)\b[0-9a-f]{40}\b"
LOCAL_PATH = r"(?i)(?:[A-Z]:[\\/]+Users[\\/]+[^\s]+|/home/[^\s]+)"
REVISION_FIELDS = ("git_head", "git_commit", "git_branch", "source_commit", "source_branch")
GENERATED_PREFIXES = (
    "artifacts/environment/",
    "artifacts/runs/",
    "results/",
    "data/raw/",
    "data/processed/",
)
TRACKED_PROVENANCE = (
    "artifacts/environment/v2/metadata.json",
    "artifacts/environment/v2/pip-check.txt",
    "artifacts/environment/v2/pip-freeze.txt",
)
# --- end of fixed values -------------------------------------------------------------------------


def strings(values) -> Column:
    """Array literal of strings."""

    return F.array(*[F.lit(v) for v in values])


def family_classifiers(family: str) -> tuple[str, ...]:
    return ("random_forest",) if family.startswith("balanced_rf") else ANALYSIS_CLASSIFIERS


def family_table(spark: SparkSession) -> DataFrame:
    """One row per (family, classifier, condition): a few dozen rows whatever the data size."""

    rows = [
        (family, feature_type, classifier, condition, position)
        for family, (feature_type, conditions) in FAMILIES.items()
        for classifier in family_classifiers(family)
        for position, condition in enumerate(conditions)
    ]
    return spark.createDataFrame(
        rows, "family string, feature_type string, classifier string, condition string, position int"
    )


def unsupported_table(spark: SparkSession) -> DataFrame:
    """Conditions that are not valid for a feature type, with the message a run must log."""

    rows = [(f, c, m) for (f, c), m in UNSUPPORTED_MESSAGES.items()]
    return spark.createDataFrame(rows, "feature_type string, condition string, unsupported_message string")

"""Schemas and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must stay equal to the scoring application's behaviour)
# ---------------------------------------------------------------------------
# Feature order of a score request and of the training table.
FEATURE_KEYS = ["age", "sex", "cp", "trestbps", "chol", "fbs", "restecg", "thalach",
                "exang", "oldpeak", "slope", "ca", "thal"]
# Training table columns: the features followed by the ordinal target (0..4).
TRAINING_COLUMNS = FEATURE_KEYS + ["target"]
# Missing-value marker in the training CSV.
MISSING_MARKER = "?"
# Risk bands on the probability fraction: < 0.3 Low, < 0.6 Moderate, else High.
BAND_LOW_MAX = 0.3
BAND_MODERATE_MAX = 0.6
BAND_NAMES = ["Low", "Moderate", "High"]
# The strict KPI counts risk_percent > 60 (not >= 60).
HIGH_KPI_PERCENT = 60.0
# Guidance text per band.
BAND_GUIDANCE = {
    "Low": "Cardiovascular risk appears low. Routine monitoring advised.",
    "Moderate": "Elevated risk detected. Clinical follow-up recommended.",
    "High": "Significant cardiac risk detected. Urgent consultation advised.",
}
# Model keys accepted by the scorer; anything else falls back to the default.
MODEL_KEYS = ["random_forest", "gradient_boosting", "logistic_regression"]
DEFAULT_MODEL = "random_forest"
# Default model_used for records without one.
UNKNOWN_MODEL = "unknown"
# Histogram: 11 equal bins over [0, 100], last bin closed.
HIST_BINS = 11
HIST_LO = 0.0
HIST_HI = 100.0
# Rolling trend window: max(1, total // 5) rows, min_periods = 1.
ROLLING_DIVISOR = 5
# Min-max normalisation of importances: (x - min) / (max - min + 1e-9), then 0.3 + 0.65 * n.
MINMAX_EPS = 1e-9
IMPORTANCE_SHADE_BASE = 0.3
IMPORTANCE_SHADE_SPAN = 0.65
# Train / test split: 20 % test, seed 42.
TEST_FRACTION = 0.2
SPLIT_SEED = 42
# Form ranges per parameter: (lo, hi, allowed codes); None = unbounded.
FORM_RULES = [
    ("age", 1.0, 120.0, None),
    ("sex", None, None, [0.0, 1.0]),
    ("trestbps", 0.0, None, None),
    ("chol", 0.0, None, None),
    ("fbs", None, None, [0.0, 1.0]),
    ("cp", 0.0, 3.0, [0.0, 1.0, 2.0, 3.0]),
    ("restecg", 0.0, 2.0, [0.0, 1.0, 2.0]),
    ("thalach", 0.0, None, None),
    ("exang", None, None, [0.0, 1.0]),
    ("oldpeak", 0.0, None, None),
    ("slope", 0.0, 2.0, [0.0, 1.0, 2.0]),
    ("ca", 0.0, 4.0, [0.0, 1.0, 2.0, 3.0, 4.0]),
    ("thal", 0.0, 3.0, [0.0, 1.0, 2.0, 3.0]),
]
# Code -> label tables shown by the scoring form.
CODE_LABELS = [
    ("sex", 1, "Male"), ("sex", 0, "Female"),
    ("fbs", 1, "Yes"), ("fbs", 0, "No"),
    ("exang", 1, "Yes"), ("exang", 0, "No"),
    ("cp", 0, "Typical angina"), ("cp", 1, "Atypical"), ("cp", 2, "Non-anginal"),
    ("cp", 3, "Asymptomatic"),
    ("restecg", 0, "Normal"), ("restecg", 1, "ST-T abnormality"), ("restecg", 2, "LV hypertrophy"),
    ("slope", 0, "Upsloping"), ("slope", 1, "Flat"), ("slope", 2, "Downsloping"),
    ("thal", 0, "Normal"), ("thal", 1, "Fixed defect"), ("thal", 2, "Reversible defect"),
    ("thal", 3, "Unknown"),
]
# Class names of the binary label.
CLASS_NAMES = [(0, "No Disease"), (1, "Disease")]
# Model key -> chart colour, with the default for unknown keys.
MODEL_COLORS = [("random_forest", "#34D399"), ("logistic_regression", "#60A5FA"),
                ("gradient_boosting", "#FBBF24")]
DEFAULT_MODEL_COLOR = "#34D399"
# Classifier defaults of the training script.
LOGREG_MAX_ITER = 1000
FOREST_TREES = 100
BOOST_ITERS = 100
BOOST_STEP = 0.1
BOOST_DEPTH = 3
# ---------------------------------------------------------------------------

TRAINING_SCHEMA = T.StructType([T.StructField(c, T.DoubleType(), True) for c in TRAINING_COLUMNS])

FEATURE_STRUCT = T.StructType([T.StructField(c, T.DoubleType(), True) for c in FEATURE_KEYS])

# Flat score record as stored (F2) plus our own record_id / source / score_date.
SCORE_RECORD_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType(), True) for c in FEATURE_KEYS]
    + [T.StructField("model_used", T.StringType(), True),
       T.StructField("probability", T.DoubleType(), True),
       T.StructField("prediction", T.IntegerType(), True),
       T.StructField("timestamp", T.TimestampNTZType(), True)])

# Legacy nested record (F3): features inside input_data, may carry _id, no model_used.
LEGACY_RECORD_SCHEMA = T.StructType(
    [T.StructField("_id", T.StringType(), True),
     T.StructField("input_data", FEATURE_STRUCT, True)]
    + [T.StructField(c, T.DoubleType(), True) for c in FEATURE_KEYS]
    + [T.StructField("model_used", T.StringType(), True),
       T.StructField("probability", T.DoubleType(), True),
       T.StructField("prediction", T.IntegerType(), True),
       T.StructField("timestamp", T.StringType(), True)])

METRICS_SCHEMA = T.StructType([T.StructField(c, T.DoubleType(), True)
                               for c in ["accuracy", "precision", "recall", "f1_score", "roc_auc"]])

COMPARISON_DDL = "map<string,struct<accuracy:double,roc_auc:double>>"

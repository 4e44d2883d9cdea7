"""Table schemas and the fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

MINUTES_PER_DAY = 1440

# The feature whitelist, in contract order.
FEATURES = [
    "age_scaled",
    "mean_daily_use_minutes",
    "mean_daily_session_count",
    "median_session_duration",
    "mean_daily_app_openings",
    "post_bedtime_use_ratio",
    "school_use_ratio",
    "games_share",
    "social_share",
    "entertainment_share",
    "education_share",
]

POSITIVE_FEATURES = FEATURES[1:5]
RATIO_FEATURES = FEATURES[5:]
SHARE_FEATURES = FEATURES[7:]

# Feature groups of the ablation study.
FEATURE_GROUPS = {
    "age": ["age_scaled"],
    "intensity": POSITIVE_FEATURES,
    "temporal_context": ["post_bedtime_use_ratio", "school_use_ratio"],
    "categories": SHARE_FEATURES,
}

TARGET = "synthetic_pmu_severity"
TARGET_RANGE = (1.0, 5.0)

# Columns that must never reach a model matrix.
FORBIDDEN_FEATURES = [
    "child_id",
    "age",
    "S",
    "B",
    "F",
    "U",
    "y_star",
    "target_noise",
    "scenario",
    "seed",
]

# App categories; "other" counts in denominators only.
APP_CATEGORIES = ["games", "social", "entertainment", "education", "other"]

# Labels of the day windows and their base weights.
WINDOW_WEIGHTS = {
    "morning_free": 1.00,
    "school": 0.20,
    "daytime_free": 1.40,
    "pre_bedtime": 1.20,
    "post_bedtime_overnight": 0.15,
}
# Shape of the waking day.
NIGHT_SEVERITY_SLOPE = 0.10
PRE_BEDTIME_MINUTES = 120
NO_SCHOOL_MORNING_END = 720

# Linear predictors (weights, intercept and gain on the log scale).
USE_TIME_PREDICTOR = {
    "weights": {"B": 0.529, "S": 0.353, "age_scaled": 0.118},
    "base": 155.0,
    "gain": 0.35,
}
SESSION_COUNT_PREDICTOR = {
    "weights": {"F": 0.5625, "B": 0.25, "S": 0.1875},
    "base": 24.0,
    "gain": 0.40,
}
EPISODE_RATE_PREDICTOR = {"weights": {"F": 1.0}, "base": 1.0 / 6.0, "gain": 0.30}

# School hours by mode.
SCHOOL_HOURS = {
    "morning": ("08:00", "12:15"),
    "afternoon": ("13:00", "17:15"),
    "full_day": ("08:15", "16:20"),
}

# Evaluation protocol.
CV_FOLDS = 5
CV_SEED = 42
SPLIT_SEED = 42
TEST_PER_STRATUM = 40
RIDGE_ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
TRAIN_FRACTIONS = [0.25, 0.50, 0.75, 1.00]
FOREST_GRID = {"max_depth": [None, 4, 8], "min_samples_leaf": [1, 5, 10], "trees": 300}
BOOSTING_GRID = {
    "max_depth": [2, 3, 4],
    "learning_rate": [0.03, 0.10],
    "min_child_weight": [1, 5],
    "rounds": 300,
}

# Intervention protocol.
CONTEXTS = ["voluntary", "bedtime", "general"]
ACTIVITY_LEVELS = ["calm", "moderate", "active"]
RESPONSES = ["selected", "rejected", "postponed", "ignored"]
SOURCES = ["child_initiated", "system_bedtime"]
BEDTIME_WINDOW_MINUTES = 60
BEDTIME_COOLDOWN_MINUTES = 60
OFFER_SIZE = 3

POPULATION = T.StructType(
    [
        T.StructField("child_id", T.LongType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("age_scaled", T.DoubleType()),
        T.StructField("S", T.DoubleType()),
        T.StructField("B", T.DoubleType()),
        T.StructField("F", T.DoubleType()),
        T.StructField("U", T.DoubleType()),
        T.StructField("school_mode", T.StringType()),
        T.StructField("school_start_minute", T.IntegerType()),
        T.StructField("school_end_minute", T.IntegerType()),
        T.StructField("school_shift_minutes", T.IntegerType()),
        T.StructField("school_start", T.StringType()),
        T.StructField("school_end", T.StringType()),
        T.StructField("bedtime_school_minute", T.IntegerType()),
        T.StructField("bedtime_non_school_minute", T.IntegerType()),
        T.StructField("bedtime_non_school_delay_minutes", T.IntegerType()),
        T.StructField("bedtime_school", T.StringType()),
        T.StructField("bedtime_non_school", T.StringType()),
    ]
)

DATASET = T.StructType(
    [T.StructField("child_id", T.LongType())]
    + [T.StructField(name, T.DoubleType()) for name in [*FEATURES, TARGET]]
)

ACTIVITY = T.StructType(
    [
        T.StructField("activity_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("interest_tags", T.ArrayType(T.StringType())),
        T.StructField("allowed_contexts", T.ArrayType(T.StringType())),
        T.StructField("activity_level", T.StringType()),
        T.StructField("bedtime_suitable", T.BooleanType()),
        T.StructField("requires_other_person", T.BooleanType()),
        T.StructField("may_require_device_interaction", T.BooleanType()),
    ]
)

INTERVENTION_RECORD = T.StructType(
    [
        T.StructField("intervention_id", T.StringType()),
        T.StructField("child_id", T.LongType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("context", T.StringType()),
        T.StructField("activities_offered", T.ArrayType(T.StringType())),
        T.StructField("response", T.StringType()),
        T.StructField("selected_activity_id", T.StringType()),
    ]
)

MODEL_CONTRACT = T.StructType(
    [
        T.StructField("model_version", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("n_features", T.IntegerType()),
        T.StructField("target", T.StringType()),
        T.StructField("target_range", T.ArrayType(T.DoubleType())),
        T.StructField("training_population", T.StringType()),
        T.StructField("development_size", T.LongType()),
        T.StructField("test_size", T.LongType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

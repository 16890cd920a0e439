"""Constants of the scoring rules, kept in one place."""

# The results of scoring, gating and drift depend on them.
SEED = 42

RISK_FEATURES = [
    "code_churn_score",
    "previous_version_error_rate",
    "avg_device_age_days",
    "is_hotfix",
    "patch_security",
]

# Known before a release ships; anything measured afterwards would leak the label.
PRE_DEPLOYMENT_FEATURES = RISK_FEATURES + [
    "days_since_previous_release",
    "patch_size_mb",
    "files_changed",
    "lines_changed",
    "pre_errors",
]

DRIFT_FEATURES = ["code_churn_score", "previous_version_error_rate", "avg_device_age_days"]

RISK_THRESHOLD = 0.50
DEVICE_AGE_THRESHOLD = 600
LABEL_QUANTILE = 0.75

CHURN_MIN = 0.14
CHURN_MAX = 0.87
QA_RISK_WEIGHT = 0.6
QA_CHURN_WEIGHT = 0.4
QA_BUCKETS = [("Critical", 0.85), ("High", 0.65), ("Medium", 0.40)]
QA_BUCKET_REST = "Low"

MONITORING_RISK_WEIGHT = 0.70
MONITORING_AGE_WEIGHT = 0.30
MONITORING_TIERS = [("Immediate Monitoring", 0.90), ("Enhanced Monitoring", 0.65)]
MONITORING_TIER_REST = "Standard Monitoring"

QA_HOURS_HIGH = 4.0
QA_HOURS_LOW = 1.0
QA_HOURS_FLAT = 2.5

SPIKE_RATIO = 1.5
SPIKE_WINDOW = 7
RELEASE_WINDOW_DAYS = 14
MIN_POST_ERRORS = 5
MIN_TICKETS = 5
MIN_DEVICES = 5

FIRST_PREVIOUS_VERSION = "9.9.9"
FIRST_RELEASE_GAP_DAYS = 7
CHURN_SCALE = 2000.0

DRIFT_THRESHOLD_PCT = 15.0
HIGH_RISK_TIMES = 1.5
REGRESSION_TIMES = 1.2
IMPROVEMENT_TIMES = 0.8
HEALTH_ERROR_WEIGHT = 30
HEALTH_RMA_WEIGHT = 40
HEALTH_TIER_WEIGHT = 30

SCORED_COLUMNS = ["firmware_version", *RISK_FEATURES, "risk_score", "high_risk_flag"]
QA_COLUMNS = [
    "firmware_version",
    "code_churn_score",
    "churn_norm",
    "risk_score",
    "high_risk_flag",
    "QA_priority_score",
    "QA_bucket",
]
MONITORING_COLUMNS = [
    "firmware_version",
    "risk_score",
    "avg_device_age_days",
    "older_device_flag",
    "monitoring_priority",
    "monitoring_tier",
]

MODEL_V1 = "v001"
MODEL_V2 = "v002"

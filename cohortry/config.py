"""Constants that define the semantics of time windows and thresholds (fixed values)."""

EPOCH = "1970-01-01"
CENSOR_DAYS = 90
FOLLOW_UP_DAYS = 730 + CENSOR_DAYS
FEATURE_DAYS = 730
LAST_FOLLOW_UP = "2022-12-31"
COHORT_START, COHORT_END = "2010-01-01", "2023-12-31"
YEAR_DAYS = 365.2422
YEAR_DAYS_TAGGING = 365.25
YEAR_DAYS_PLAIN = 365.0
DECADE_DAYS = 3653.0
MIN_AGE_YEARS = 35
TIME_BINS = ((0, 730), (730, 820))
MIN_CODE_COUNT = 100
HIGH_RISK_MASS, HIGH_RISK_RATIO = 0.005, 3.0
CORRELATION_LIMIT = 0.95

"""Fixed values of the validation operators (defaults that callers may rely on)."""

DEFAULT_SIGNIFICANCE_ALPHA = 0.05
DEFAULT_SIGNIFICANCE_T = 2.0
DEFAULT_TRAIN_FRAC = 0.7
DEFAULT_MIN_N_PER_SPLIT = 8
DEFAULT_ROBUST_RETENTION = 0.7
DEFAULT_MODERATE_RETENTION = 0.4
DEFAULT_OVERFIT_RETENTION = 0.3
MIN_RELIABLE_CLUSTERS = 20
DEFAULT_N_GROUPS = 6
DEFAULT_N_TEST_GROUPS = 2
DEFAULT_PCT_ROBUST_FOR_ROBUST = 0.7
DEFAULT_PCT_ROBUST_FOR_MODERATE = 0.4
DEFAULT_MIN_OBS_PER_COHORT = 10
DEFAULT_MIN_PERIODS = 3

ROBUST, MODERATE, WEAK, OVERFITTED = "ROBUST", "MODERATE", "WEAK", "OVERFITTED"
INSUFFICIENT_DATA, INSUFFICIENT_INSAMPLE_EDGE = "INSUFFICIENT_DATA", "INSUFFICIENT_INSAMPLE_EDGE"

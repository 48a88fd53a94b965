"""The public names in one place."""

from .functions.constants import *  # noqa: F403
from .functions.student import critical_value as critical_t  # noqa: F401
from .operators.cohort import (  # noqa: F401
    FamaMacBethMultiResult,
    FamaMacBethResult,
    cohort_group_diffs,
    cohort_multi_slopes,
    cohort_slopes,
    estimate_test,
    fama_macbeth_group_diff,
    fama_macbeth_multi_regression,
    fama_macbeth_regression,
)
from .operators.cpcv import (  # noqa: F401
    CPCVPathResult,
    CPCVResult,
    assign_groups,
    build_split_frames,
    classify_cpcv_overall,
    cpcv_paths,
    cpcv_validate,
    format_cpcv_print_line,
    format_cpcv_registry_note,
    generate_cpcv_splits,
)
from .operators.multiple import (  # noqa: F401
    benjamini_hochberg_fdr,
    bonferroni_correction,
    correct,
    correction_summary,
    holm_correction,
    summarize_correction,
)
from .operators.stats import StatResult, StatSpec, evaluate, group_diff, stat_group_diff, stat_vs_zero, vs_zero, with_labels, with_significance  # noqa: F401
from .operators.timeline import apply_purge_embargo, chronological_split, date_sort_key  # noqa: F401
from .operators.verdict import classify_overfitting  # noqa: F401
from .operators.walk_forward import WalkForwardResult, walk_forward, walk_forward_validate  # noqa: F401
from .sources.store import KeyedStore, append_dedup  # noqa: F401

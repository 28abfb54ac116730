from assayflow.functions.scalar import (  # noqa: F401
    clean_id, clean_visit, false_if_null, hash_uniform, last_path_segment,
    log2_safe, nan_to_null, neg_log10, ratio, short_label,
)
from assayflow.functions.tdist import t_critical, t_two_sided_p  # noqa: F401

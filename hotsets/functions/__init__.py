"""Column-expression helpers (all built-in Spark functions, JVM side)."""

from hotsets.functions.naming import dataset_parts, with_dataset_parts
from hotsets.functions.timefn import day_string, week_of_day_string, week_of_epoch_ms, week_of_epoch_s
from hotsets.functions.numeric import log_bucket, ratio_floor, safe_ratio
from hotsets.functions.hashing import unit_hash

__all__ = [
    "dataset_parts", "with_dataset_parts", "day_string", "week_of_day_string",
    "week_of_epoch_ms", "week_of_epoch_s", "log_bucket", "ratio_floor", "safe_ratio", "unit_hash",
]

"""Numeric helpers with Spark-4 safe semantics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double, NULL when b is 0 (ANSI ``/`` would raise)."""
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def ratio_floor(a: Column | str, b: Column | str) -> Column:
    """FLOOR(a / b) as bigint; NULL when b is 0."""
    return F.floor(safe_ratio(a, b))


def log_bucket(x: Column | str) -> Column:
    """CEILING(LN(x)) as bigint: log-scale histogram bucket.

    ``ln`` of 0 or a negative value is NULL, so those rows form a NULL bucket.
    """
    return F.ceil(F.ln(_c(x)))

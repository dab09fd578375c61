"""Dataset-name parsing.

A dataset name is a path ``/<primary>/<era>-<version>[-...]/<tier>``.  The
split on ``/`` yields an empty element 0, so elements 1, 2, 3 are taken;
element 2 is split again on ``-`` and its first two parts are kept.
``get`` returns NULL for a missing element (plain ``[]`` raises under ANSI).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _part(c: Column, sep: str, i: int) -> Column:
    return F.get(F.split(c, sep), F.lit(i))


def dataset_parts(name: Column | str) -> dict[str, Column]:
    c = F.col(name) if isinstance(name, str) else name
    processed = _part(c, "/", 2)
    return {
        "primary_dataset": _part(c, "/", 1),
        "processed_dataset": processed,
        "acquisition_era": _part(processed, "-", 0),
        "processing_version": _part(processed, "-", 1),
        "datatier": _part(c, "/", 3),
    }


def with_dataset_parts(df: DataFrame, name_col: str = "dataset_name") -> DataFrame:
    """Add the five derived name columns (one projection, no shuffle)."""
    return df.withColumns(dataset_parts(name_col))

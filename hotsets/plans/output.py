"""Output normalisation for result comparison.

Float sums depend on the order of addition, which differs between engines
and between runs; registered queries therefore round double columns
(money-like sums to 2 places, ratios to 9).  The library operators never
round: this is applied only to the registered query outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType


def rounded(df: DataFrame, digits: int = 2, overrides: dict[str, int] | None = None) -> DataFrame:
    overrides = overrides or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), overrides.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


"""Deterministic per-row uniform numbers for repeatable sampling.

``u = int(first 8 hex digits of md5(salt || key), 16) / 2**32`` lies in
[0, 1), depends only on the row's key and the salt, and is reproducible in
any engine that has md5 (so splits can be checked by plain SQL).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_POW_32 = 4294967296.0


def unit_hash(key: Column, salt: str) -> Column:
    h = F.md5(F.concat(F.lit(salt), key))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(TWO_POW_32)


def row_key(cols: list[str], sep: str = "|") -> Column:
    """Text key of a row from its group columns: ``=value``, or ``-`` for NULL,
    so that a NULL keeps its place."""
    return F.concat_ws(sep, *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols])

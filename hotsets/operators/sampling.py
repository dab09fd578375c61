"""Repeatable class balancing and train/test split.

Each row gets ``u = unit_hash(salt || row key)`` in [0, 1).  A row is kept
(or put in training) when ``u`` is below the fraction.  The result depends
only on the row and the salt: the same rows on every run and on any
cluster size, with no shuffle.  Two different salts keep the balancing and
the split independent (with one salt, every kept negative would also fall
into training).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotsets.functions.hashing import row_key, unit_hash
from hotsets.schemas import POPULARITY_KEYS

NEG_FRACTION = 0.15
TRAIN_FRACTION = 0.7
BALANCE_SALT = "balance:"
SPLIT_SALT = "split:"


# the numbers of a row as columns: balancing, split
DRAWS = {"_balance": BALANCE_SALT, "_split": SPLIT_SALT}


def with_draws(df: DataFrame, key_cols: list[str] = POPULARITY_KEYS) -> DataFrame:
    """Add both numbers of each row (``DRAWS``), for a table that is sampled many times: the row's key is
    hashed once, and neither hashed nor needed again where ``drawn`` names the number's column."""
    return df.withColumns({name: unit_hash(row_key(key_cols), salt) for name, salt in DRAWS.items()})


def balanced_sample(labelled: DataFrame, neg_fraction: float = NEG_FRACTION,
                    key_cols: list[str] = POPULARITY_KEYS, salt: str = BALANCE_SALT, drawn: str | None = None) -> DataFrame:
    """All positives plus ``neg_fraction`` of the negatives: one filter, one scan."""
    u = unit_hash(row_key(key_cols), salt) if drawn is None else F.col(drawn)
    return labelled.filter((F.col("label") != 0) | (u < F.lit(neg_fraction)))


def with_split(df: DataFrame, train_fraction: float = TRAIN_FRACTION,
               key_cols: list[str] = POPULARITY_KEYS, salt: str = SPLIT_SALT, drawn: str | None = None) -> DataFrame:
    """Add ``split`` = 'train' | 'test' (disjoint and complete)."""
    u = unit_hash(row_key(key_cols), salt) if drawn is None else F.col(drawn)
    return df.withColumn("split", F.when(u < F.lit(train_fraction), F.lit("train")).otherwise(F.lit("test")))


def train_test_split(df: DataFrame, train_fraction: float = TRAIN_FRACTION,
                     key_cols: list[str] = POPULARITY_KEYS, salt: str = SPLIT_SALT):
    s = with_split(df, train_fraction, key_cols, salt)
    return (s.filter(F.col("split") == "train").drop("split"),
            s.filter(F.col("split") == "test").drop("split"))

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotsets.sources.handoff import hand_off as handoff  # noqa: F401  (steps here write and drop tables as all others do)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def same(a: Column, b: Column) -> Column:
    """Null-safe equality (two NULL ids name the same, unnamed document)."""
    return a.eqNullSafe(b)


def keep_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with exactly ``columns``, safe for names that hold dots or backticks."""
    return df.select(*[quoted(c) for c in columns])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: bytes of one batch that a task hands to Python; texts may be long
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Let tasks hand rows to Python in small batches, whatever the length of the texts.

    This is a setting of the session; one that is not Spark's default stays.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":  # the default
        spark.conf.set(key, BATCH_BYTES)


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)

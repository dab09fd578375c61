"""Bucketed tables: rows of a key lie in one bucket, so joins and aggregates by
it need no exchange.

The catalog and the daily accesses share the file key.  Written once in the
same number of buckets, they meet in every weekly job without moving; only the
grouped result is shuffled, by dataset.  Choose ``buckets`` so that a bucket of the
larger table has some hundred megabytes (``buckets_for`` its rows); both tables need the same number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from hotsets.sources.handoff import owner_of


#: a task sorts and groups a bucket, at some 600 bytes a row
ROWS_PER_BUCKET = 1_000_000


def buckets_for(rows: int, least: int) -> int:
    """``least`` buckets, doubled until none has more than ``ROWS_PER_BUCKET`` of so many evenly spread rows."""
    buckets = least
    while rows > buckets * ROWS_PER_BUCKET:
        buckets *= 2
    return buckets


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, mode: str = "errorifexists") -> DataFrame:
    """``df`` as the catalog table ``name``, bucketed and sorted by ``key`` (one file per bucket and write).

    ``mode="append"`` adds new days to the table's buckets.  Without a ``path`` the table and its files
    belong to the owner of ``df``'s session and go with it.
    """
    spark = df.sparkSession
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode(mode)
    if mode != "append":
        if path is None:
            owner = owner_of(spark)
            path = owner.new_path()
            owner.tables.append(name)
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return spark.table(name)


def co_located(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the request to join them where they lie (a broadcast would read
    one side whole into every executor, which its size does not bound)."""
    return left, right.hint("merge")

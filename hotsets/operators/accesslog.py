"""Cleaning of the raw file-access log (one narrow projection + filter)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotsets.functions.timefn import day_string

# fixed value: protocol recorded for every access of this log
XROOTD = "xrootd"


def clean_accesses(raw: DataFrame, protocol: str = XROOTD) -> DataFrame:
    """Raw access rows -> the 13-column cleaned table.

    Keeps rows with a positive duration, positive bytes at close and no
    parse error.  An empty server user becomes ``unknown``; a NULL one
    stays NULL.  Filter and projection are narrow, so Catalyst pushes the
    byte/corrupt predicates into the scan and prunes unused columns.
    """
    duration = F.col("end_time") - F.col("start_time")
    su = F.col("server_username")
    return raw.filter(
        (duration > 0) & (F.col("read_bytes_at_close") > 0) & F.col("_corrupt_record").isNull()
    ).select(
        day_string("end_time").alias("TDay"),
        F.col("start_time").alias("ots"),
        F.col("end_time").alias("cts"),
        "file_lfn", "client_domain", "client_host",
        F.when(su == "", F.lit("unknown")).otherwise(su).alias("server_username"),
        "server_domain", "server_host", "server_site",
        F.lit(protocol).alias("user_protocol"),
        duration.alias("proctime"),
        F.col("read_bytes_at_close").alias("readbytes"),
    )

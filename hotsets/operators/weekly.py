"""Weekly popularity tables from accesses and from grid jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotsets.functions.naming import with_dataset_parts
from hotsets.functions.timefn import week_of_epoch_ms, week_of_epoch_s, year_of_epoch_s
from hotsets.schemas import POPULARITY_COLUMNS

# fixed value: server domain recorded for every grid job
JOB_SERVER_DOMAIN = "cern.ch"

_RAW_KEYS = ["client_domain", "server_domain", "server_site", "user_protocol"]


def to_canonical(df: DataFrame, *before: str) -> DataFrame:
    """Select the 16 popularity columns in canonical order and types (after those named)."""
    casts = {"week": "int", "dataset_size": "double", "numaccesses": "double",
             "proctime": "double", "readbytes": "double"}
    return df.select(*before, *[F.col(c).cast(casts[c]).alias(c) if c in casts else F.col(c)
                       for c in POPULARITY_COLUMNS])


def access_popularity(clean: DataFrame, catalog: DataFrame, file_size_once: bool = False, by_year: bool = False) -> DataFrame:
    """Join cleaned accesses to the file catalog and aggregate per week.

    Keys: week, dataset, client domain, catalog user, server domain, site,
    protocol.  Metrics: SUM(filesize) over joined rows, COUNT(client_host),
    SUM(proctime), SUM(readbytes).  An access whose file is not in the
    catalog is dropped; a file listed twice counts twice.

    One plan at every size: accesses are first reduced to one row per (week,
    file, access-side keys), with map-side partial aggregation, then joined to
    the catalog; Spark broadcasts a catalog that is small in bytes and
    shuffles a large one.  A file holding a large share of all accesses is
    one row per week and key by then, so it does not skew the join.
    SUM(filesize) becomes SUM(filesize * rows); the other metrics add up
    (also with duplicate catalog keys, since every partial row is multiplied
    alike).

    ``file_size_once``: ``dataset_size`` counts each accessed file once per
    weekly group (the size of the data that was read) instead of once per
    access.  ``by_year``: weeks of different years stay apart, by a first
    column ``year`` (that of the ISO week).
    """
    period = {"year": year_of_epoch_s("cts")} if by_year else {}
    period["week"] = week_of_epoch_s("cts")
    cat = catalog.select("file_lfn", "dataset_name", F.col("usernameXX").alias("username"), "filesize")
    acc = clean.select(*[c.alias(n) for n, c in period.items()], "file_lfn", *_RAW_KEYS,
                       "client_host", "proctime", "readbytes")
    acc = acc.groupBy(*period, "file_lfn", *_RAW_KEYS).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count("client_host").alias("_hosts"),
        F.sum("proctime").alias("_proctime"),
        F.sum("readbytes").alias("_readbytes"),
    )
    size = F.col("filesize") if file_size_once else F.col("filesize") * F.col("_rows")
    out = acc.join(cat, "file_lfn").groupBy(
        *period, "dataset_name", "client_domain", "username", "server_domain", "server_site", "user_protocol").agg(
        F.sum(size).alias("dataset_size"),
        F.sum("_hosts").alias("numaccesses"),
        F.sum("_proctime").alias("proctime"),
        F.sum("_readbytes").alias("readbytes"),
    )
    # name parts are functions of dataset_name: derive after the aggregate
    # instead of carrying five more group keys through the shuffle
    out = with_dataset_parts(out)
    return to_canonical(out, "year") if by_year else to_canonical(out)


def jobs_popularity(jobs: DataFrame, server_domain: str = JOB_SERVER_DOMAIN) -> DataFrame:
    """Weekly popularity from grid job records.

    COUNT(InputCollection) skips jobs without a dataset (their group gets
    0); dataset size is 0 and the server domain the one given.  The
    wall-clock sum lands in ``readbytes`` (the table's column layout).
    """
    out = jobs.groupBy(
        week_of_epoch_ms("FinishedTimeStamp").alias("week"),
        F.col("InputCollection").alias("dataset_name"),
        F.col("TargetCE").alias("client_domain"),
        F.col("SiteName").alias("server_site"),
        F.col("ProtocolUsed").alias("user_protocol"),
        F.col("GridName").alias("username"),
    ).agg(
        F.count("InputCollection").alias("numaccesses"),
        F.sum("WrapCPU").alias("proctime"),
        F.sum("WrapWC").alias("readbytes"),
    )
    out = out.withColumns({"server_domain": F.lit(server_domain), "dataset_size": F.lit(0.0)})
    return to_canonical(with_dataset_parts(out))


def popularity_union(access_pop: DataFrame, jobs_pop: DataFrame) -> DataFrame:
    """Both weekly tables on the canonical schema, tagged by source
    (UNION ALL by column name, no shuffle)."""
    return (access_pop.withColumn("source", F.lit("xrootd"))
            .unionByName(jobs_pop.withColumn("source", F.lit("crab"))))

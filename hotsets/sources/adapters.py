"""Present the driver's TPC-H-like test tables as the domain tables.

The domain jobs (cleaning, weekly popularity, replicas, features) take
DataFrames with the domain column names.  These adapters derive such
DataFrames from ``lineitem``, ``orders``, ``part``, ``supplier``,
``nation``, ``region``, ``events`` and ``documents``, so every job's work
grows with the test tables.  The same mapping is written in SQL in
``hotsets.plans.oracle`` for the DuckDB cross-check.

Mapping (one place, used everywhere):

* file catalog  <- part: file ``p_partkey``, size ``p_retailprice``,
  dataset ``/<p_type>/<p_name with '-' for ' '>/<p_brand>``,
  user ``'user' || p_size``.
* access log    <- lineitem x orders x supplier x nation x region:
  start ``o_orderdate``, end ``l_shipdate`` (epoch seconds), bytes
  ``l_extendedprice``, file ``l_partkey``, client domain ``l_returnflag``,
  client host ``o_custkey``, server user ``l_linestatus``,
  site ``n_name``, server domain ``r_name``.
* replica snapshots <- lineitem x part x supplier x nation: snapshot
  ``l_linestatus``, block ``p_partkey`` of ``p_retailprice`` bytes, replica
  bytes ``l_extendedprice``, node ``n_name`` plus a tape/buffer/export
  suffix for some nations.
* jobs          <- events: finish ``ts`` in ms, dataset from
  ``event_type`` (NULL for ``error`` events), user ``user_id``,
  cpu ``value``, wall clock ``2 * value``.
* raw JSON log lines <- events.props, truncated for ``error`` events so
  they do not parse.
* analyses      <- documents: conference ``lang``, group ``source``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _epoch_s(c: str) -> Column:
    # timestamp_ntz -> instant in the session zone (UTC) -> epoch seconds
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def dataset_name_of_part() -> Column:
    return F.concat(F.lit("/"), F.col("p_type"), F.lit("/"),
                    F.regexp_replace(F.col("p_name"), " ", "-"), F.lit("/"), F.col("p_brand"))


def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        dataset_name_of_part().alias("dataset_name"),
        F.col("p_partkey").alias("block_id"),
        F.col("p_partkey").alias("file_lfn"),
        F.col("p_partkey").alias("file_id"),
        F.col("p_retailprice").alias("filesize"),
        F.concat(F.lit("user"), F.col("p_size").cast("string")).alias("usernameXX"),
    )


def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset list (id, dataset_name): one row per dataset of the catalog."""
    return (file_catalog(spark, sf_dir).groupBy("dataset_name")
            .agg(F.min("file_id").alias("id")).select("id", "dataset_name"))


def _nation_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nation (25 rows) and region (5 rows) have a fixed size at every scale
    # factor, so broadcasting them is bounded by construction.
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_name", "r_name")


def with_server(accesses: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses with the site and domain of their supplier.  Supplier grows; the join strategy is left
    to Spark's size estimates and AQE.  It is joined as it is read, and nation and region after it:
    joined with them first, it has no estimate that Spark could choose a broadcast by in
    time, and all accesses are shuffled for it."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nr = _nation_region(spark, sf_dir)
    found = accesses.join(s, accesses.l_suppkey == s.s_suppkey).join(F.broadcast(nr), s.s_nationkey == nr.n_nationkey)
    return found.withColumnsRenamed({"n_name": "server_site", "r_name": "server_domain"})


def access_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag",
        "l_linestatus", "l_shipdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    acc = li.join(o, li.l_orderkey == o.o_orderkey)
    return with_server(acc, spark, sf_dir).select(
        F.lit(None).cast("string").alias("_corrupt_record"),
        F.col("l_returnflag").alias("client_domain"),
        F.col("o_custkey").cast("string").alias("client_host"),
        _epoch_s("l_shipdate").alias("end_time"),
        F.col("l_partkey").alias("file_lfn"),
        F.col("l_extendedprice").alias("read_bytes_at_close"),
        F.col("server_domain"),
        F.col("l_suppkey").cast("string").alias("server_host"),
        F.col("server_site"),
        F.col("l_linestatus").alias("server_username"),
        _epoch_s("o_orderdate").alias("start_time"),
    )


def node_name_of_nation() -> Column:
    # Some nations stand for tape, buffer and export nodes, which the
    # replica job must leave out; the others are disk nodes.
    k = F.col("n_nationkey") % 8
    suffix = (F.when(k == 1, F.lit("_MSS")).when(k == 2, F.lit("_Buffer"))
              .when(k == 3, F.lit("_Export")).otherwise(F.lit("")))
    return F.concat(F.col("n_name"), suffix)


def replica_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_extendedprice", "l_linestatus")
    p = table(spark, sf_dir, "part")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, sf_dir, "nation")
    nodes = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        "s_suppkey", node_name_of_nation().alias("node_name"), F.col("n_nationkey").cast("long").alias("node_id"))
    x = li.join(p, li.l_partkey == p.p_partkey).join(nodes, li.l_suppkey == nodes.s_suppkey)
    return x.select(
        F.col("l_linestatus").alias("now"),
        dataset_name_of_part().alias("dataset_name"),
        F.col("p_partkey").alias("block_id"),
        F.col("p_retailprice").alias("block_bytes"),
        "node_name", "node_id",
        F.col("l_extendedprice").alias("br_node_bytes"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    dataset = F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("/"), F.col("event_type"), F.lit("/Run2024A-v1/AOD")))
    return e.select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("FinishedTimeStamp"),
        dataset.alias("InputCollection"),
        F.concat(F.lit("ce-"), (F.col("user_id") % 7).cast("string")).alias("TargetCE"),
        F.concat(F.lit("T2_SITE_"), (F.col("user_id") % 5).cast("string")).alias("SiteName"),
        F.when(F.col("value") > 25, F.lit("remote")).otherwise(F.lit("local")).alias("ProtocolUsed"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("GridName"),
        F.col("value").alias("WrapCPU"),
        (F.col("value") * 2).alias("WrapWC"),
    )


def access_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, line): JSON log lines, the ``error`` ones damaged."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_type") == "error", F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return e.select("event_id", line.alias("line"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    size_class = (F.when(F.col("n_chars") >= 10000, F.lit("large"))
                  .when(F.col("n_chars") >= 1000, F.lit("medium")).otherwise(F.lit("small")))
    none = F.lit(None).cast("string")
    return d.select(
        F.col("lang").alias("Conference"), F.col("doc_id").cast("string").alias("code"),
        F.col("source").alias("physWG"), none.alias("name"), F.col("source").alias("sources"),
        none.alias("creatorName"), none.alias("targetDatePreApp"), none.alias("targetDatePub"),
        none.alias("contact"), size_class.alias("samples"), F.col("text").alias("description"),
    )

"""Weekly access popularity maintained from a stream of log files.

The access log arrives as daily folders.  Instead of re-reading the year,
a file-source stream cleans each new batch, joins it to the (static) file
catalog, and updates per-week aggregates held in the state store.  The
week is a 7-day event-time window starting on Monday (epoch day 0 was a
Thursday, hence the 4-day offset); unlike the batch table, weeks of
different years stay apart.  A watermark bounds the state: once event
time has passed a week's end plus the allowed lateness, its rows are final
(append mode) and its state is dropped.  Rows that come later than that are
counted by Spark as ``numRowsDroppedByWatermark`` in the query's progress;
the batch job over the files has them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from hotsets.functions.naming import with_dataset_parts
from hotsets.operators.accesslog import clean_accesses
from hotsets.sources.readers import typed_numbers

WEEK = "7 days"
MONDAY_OFFSET = "4 days"


def read_access_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "json",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream, with the batch readers' rules: JSON numbers in any
    form, malformed JSON lines kept in ``_corrupt_record``, and a malformed
    CSV line stops the query."""
    as_text = ", ".join(f"`{f.name}` string" for f in schema.fields)
    r = spark.readStream.schema(as_text if fmt == "json" else schema).format(fmt)
    if fmt == "json":
        r = r.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    elif fmt == "csv":
        # _corrupt_record is a data column of the CSV layout (see readers)
        r = r.option("mode", "FAILFAST").option("columnNameOfCorruptRecord", "_malformed_csv_line")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return typed_numbers(r.load(path), schema) if fmt == "json" else r.load(path)


def weekly_access_stream(raw_stream: DataFrame, catalog: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Streaming weekly table: same keys and metrics as the batch job, plus
    ``week_start``."""
    clean = clean_accesses(raw_stream).withColumn("event_time", F.timestamp_seconds("cts"))
    clean = clean.withWatermark("event_time", lateness)
    cat = catalog.select("file_lfn", "dataset_name", F.col("usernameXX").alias("username"), "filesize")
    joined = clean.join(cat, "file_lfn")  # stream-static join: no state
    agg = joined.groupBy(
        F.window("event_time", WEEK, WEEK, MONDAY_OFFSET).alias("w"), "dataset_name",
        "client_domain", "username", "server_domain", "server_site", "user_protocol",
    ).agg(
        F.sum("filesize").alias("dataset_size"),
        F.count("client_host").cast("double").alias("numaccesses"),
        F.sum("proctime").cast("double").alias("proctime"),
        F.sum("readbytes").cast("double").alias("readbytes"),
    )
    out = agg.select(F.weekofyear(F.col("w.start")).alias("week"), F.col("w.start").alias("week_start"),
                     *[c for c in agg.columns if c != "w"])
    return with_dataset_parts(out)


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(weekly: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet",
          available_now: bool = False, rocksdb_state: bool = False) -> StreamingQuery:
    """Append finished weeks to ``sink_path`` (exactly once through the
    checkpoint folder, which must be on shared storage).

    ``rocksdb_state`` keeps the open weeks' groups in RocksDB on local disk
    instead of the executors' heap (state is still snapshotted to the
    checkpoint folder), for a state larger than executor memory."""
    w = (weekly.writeStream.outputMode("append").format(fmt)
         .option("path", sink_path).option("checkpointLocation", checkpoint)
         .partitionBy("week"))
    if available_now:
        w = w.trigger(availableNow=True)
    if not rocksdb_state:
        return w.start()
    # the query takes its settings when it starts: set the provider for
    # this start only and leave the session as it was
    conf, key = weekly.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    conf.set(key, ROCKSDB_PROVIDER)
    try:
        return w.start()
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)

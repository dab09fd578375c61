"""Fixed schemas of the domain tables.

Column names are fixed values of the data model (they must match the
files the jobs read); types are explicit so no reader ever infers them.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# --- fixed values: column lists of the source files ------------------------

# Raw file-access log, 48 columns (JSON lines, or CSV in the same order).
ACCESS_RAW = _struct([
    ("_corrupt_record", S), ("app_info", S), ("client_domain", S), ("client_host", S),
    ("end_time", L), ("file_lfn", S), ("file_size", L), ("read_average", D),
    ("read_bytes", L), ("read_bytes_at_close", L), ("read_max", L), ("read_min", L),
    ("read_operations", L), ("read_sigma", D), ("read_single_average", D),
    ("read_single_bytes", L), ("read_single_max", L), ("read_single_min", L),
    ("read_single_operations", L), ("read_single_sigma", D), ("read_vector_average", D),
    ("read_vector_bytes", L), ("read_vector_count_average", D), ("read_vector_count_max", L),
    ("read_vector_count_min", L), ("read_vector_count_sigma", D), ("read_vector_max", L),
    ("read_vector_min", L), ("read_vector_operations", L), ("read_vector_sigma", D),
    ("server_domain", S), ("server_host", S), ("server_site", S), ("server_username", S),
    ("start_time", L), ("unique_id", S), ("user_dn", S), ("user_fqan", S),
    ("user_protocol", S), ("user_role", S), ("user_vo", S), ("write_average", D),
    ("write_bytes", L), ("write_bytes_at_close", L), ("write_max", L), ("write_min", L),
    ("write_operations", L), ("write_sigma", D),
])

# Cleaned accesses, 13 columns (the form the cleaning job writes).
ACCESS_CLEAN = _struct([
    ("TDay", S), ("ots", L), ("cts", L), ("file_lfn", S), ("client_domain", S),
    ("client_host", S), ("server_username", S), ("server_domain", S), ("server_host", S),
    ("server_site", S), ("user_protocol", S), ("proctime", L), ("readbytes", L),
])

# Older 12-column file form of the cleaned accesses.
ACCESS_CLEAN_V1 = _struct([
    ("TDay", S), ("ots", L), ("cts", L), ("file_lfn", S), ("client_host", S),
    ("server_username", S), ("client_domain", S), ("server_domain", S), ("server_site", S),
    ("user_protocol", S), ("proctime", L), ("readbytes", L),
])

# File catalog: file -> block -> dataset, 14 columns.
FILE_CATALOG = _struct([
    ("dataset_name", S), ("dataset_id", L), ("dataset_is_open", S), ("dataset_time_create", D),
    ("block_name", S), ("block_id", L), ("block_time_create", D), ("block_is_open", S),
    ("file_lfn", S), ("file_id", L), ("filesize", D), ("usernameXX", S), ("checksum", S),
    ("file_time_create", D),
])

# Block replica snapshots, 28 columns (ten names contain a dot).
REPLICA_SNAPSHOTS = _struct([
    ("now", S), ("dataset_name", S), ("dataset_id", L), ("dataset_is_open", S),
    ("dataset_time_create", D), ("dataset_time_update", D), ("block_name", S), ("block_id", L),
    ("block_files", L), ("block_bytes", D), ("block_is_open", S), ("block_time_create", D),
    ("block_time_update", D), ("node_name", S), ("node_id", L), ("br.is_active", S),
    ("br.src_files", L), ("br.src_bytes", D), ("br.dest_files", L), ("br.dest_bytes", D),
    ("br.node_files", L), ("br_node_bytes", D), ("br.xfer_files", L), ("br.xfer_bytes", D),
    ("br.is_custodial", S), ("br.user_group", S), ("replica_time_create", D),
    ("replica_time_update", D),
])

# Grid job records: the 8 fields the jobs use.
JOBS = _struct([
    ("FinishedTimeStamp", L), ("InputCollection", S), ("TargetCE", S), ("SiteName", S),
    ("ProtocolUsed", S), ("GridName", S), ("WrapCPU", D), ("WrapWC", D),
])

# Analysis records, 11 fields.
ANALYSES = _struct([
    ("Conference", S), ("code", S), ("physWG", S), ("name", S), ("sources", S),
    ("creatorName", S), ("targetDatePreApp", S), ("targetDatePub", S), ("contact", S),
    ("samples", S), ("description", S),
])

# Dataset list, 2 columns.
DATASET_CATALOG = _struct([("id", L), ("dataset_name", S)])

# Weekly popularity table, 16 columns, canonical order.
POPULARITY = _struct([
    ("week", I), ("dataset_name", S), ("primary_dataset", S), ("processed_dataset", S),
    ("acquisition_era", S), ("processing_version", S), ("datatier", S), ("client_domain", S),
    ("username", S), ("server_domain", S), ("server_site", S), ("user_protocol", S),
    ("dataset_size", D), ("numaccesses", D), ("proctime", D), ("readbytes", D),
])

# --- end of fixed values ----------------------------------------------------

POPULARITY_COLUMNS = [f.name for f in POPULARITY.fields]
DATASET_PART_COLUMNS = ["primary_dataset", "processed_dataset", "acquisition_era",
                        "processing_version", "datatier"]
# Group keys of a weekly popularity row (everything but the four metrics).
POPULARITY_KEYS = ["week", "dataset_name", "client_domain", "username",
                   "server_domain", "server_site", "user_protocol"]
METRICS = ["dataset_size", "numaccesses", "proctime", "readbytes"]


def ddl(schema: T.StructType) -> str:
    """DDL string of a schema, with back-quoted names (dotted names need it)."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)

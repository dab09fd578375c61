"""Registered queries through files: the domain tables are written in the
original formats to the shared folder and come back through the real readers.

Byte counts of the access log are whole numbers in these formats, so the
test table's prices are cut off; every tenth JSON line is damaged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from hotsets import schemas
from hotsets.operators import evaluate, replicas
from hotsets.operators.accesslog import clean_accesses
from hotsets.plans.domain import Domain
from hotsets.plans.output import rounded
from hotsets.plans.queries import RATIO_DIGITS, fine_rule_predictions, register, rule_predictions
from hotsets.sources import readers, sinks
from hotsets.sources.handoff import owner_of


def in_layout(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in its order; those that ``df`` lacks are NULL."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _folder(spark: SparkSession) -> str:
    return owner_of(spark).new_path()


def _access_log(d: Domain) -> DataFrame:
    return in_layout(d.access_raw.withColumn("read_bytes_at_close", F.floor("read_bytes_at_close")), schemas.ACCESS_RAW)


@register("file_dataset_catalog")
def q_file_dataset_catalog(spark, sf_dir):
    path = _folder(spark)
    sinks.write_csv(Domain(spark, sf_dir).dataset_catalog, path)
    return readers.read_dataset_catalog(spark, path)


@register("file_access_json")
def q_file_access_json(spark, sf_dir):
    """JSON lines, some damaged, read and cleaned."""
    path, line = _folder(spark), F.to_json(F.struct(*[F.col(f.name) for f in schemas.ACCESS_RAW.fields if f.name != readers.CORRUPT]))
    damaged = F.when(F.col("file_lfn") % 10 == 0, F.expr("left(line, length(line) - 3)")).otherwise(F.col("line"))
    _access_log(Domain(spark, sf_dir)).withColumn("line", line).select(damaged.alias("value")).write.text(path)
    return clean_accesses(readers.read_access_log(spark, path))


@register("file_access_csv")
def q_file_access_csv(spark, sf_dir):
    """The 48-column CSV form, read and cleaned."""
    path = _folder(spark)
    sinks.write_csv(_access_log(Domain(spark, sf_dir)), path)
    return clean_accesses(readers.read_access_log(spark, path, fmt="csv"))


@register("file_access_clean")
def q_file_access_clean(spark, sf_dir):
    path = _folder(spark)
    clean = clean_accesses(_access_log(Domain(spark, sf_dir)))
    sinks.write_csv(in_layout(clean, schemas.ACCESS_CLEAN), path)
    return readers.read_access_clean(spark, path)


@register("file_access_clean_legacy")
def q_file_access_clean_legacy(spark, sf_dir):
    """The older 12-column form."""
    path = _folder(spark)
    clean = clean_accesses(_access_log(Domain(spark, sf_dir)))
    sinks.write_csv(in_layout(clean, schemas.ACCESS_CLEAN_V1), path)
    return readers.read_access_clean(spark, path, legacy=True)


@register("file_file_catalog")
def q_file_file_catalog(spark, sf_dir):
    path = _folder(spark)
    sinks.write_csv(in_layout(Domain(spark, sf_dir).file_catalog, schemas.FILE_CATALOG), path)
    return readers.read_file_catalog(spark, path).select("dataset_name", "block_id", "file_lfn", "file_id", F.round("filesize", 2).alias("filesize"), "usernameXX")


@register("file_snapshots")
def q_file_snapshots(spark, sf_dir):
    """Snapshots in ``time=`` folders, read as one table; replication factors by snapshot."""
    path = _folder(spark)
    snaps = in_layout(Domain(spark, sf_dir).replica_snapshots, schemas.REPLICA_SNAPSHOTS)
    snaps.withColumn("time", F.concat(F.lit("snap-"), F.col("now"))).write.partitionBy("time").option("header", False).csv(path)
    read = readers.read_replica_snapshots(spark, f"{path}/time=*", base_path=path)
    return replicas.replication_factor(read.where(F.col("time") == F.concat(F.lit("snap-"), F.col("now"))), per_snapshot=True)


@register("file_analyses")
def q_file_analyses(spark, sf_dir):
    path = _folder(spark)
    Domain(spark, sf_dir).analyses.write.json(path)
    return readers.read_analyses(spark, path).select([f.name for f in schemas.ANALYSES.fields])


@register("file_popularity")
def q_file_popularity(spark, sf_dir):
    path = _folder(spark)
    sinks.write_popularity(rounded(Domain(spark, sf_dir).popularity), path)
    return readers.read_popularity(spark, path)


@register("file_predictions")
def q_file_predictions(spark, sf_dir):
    """``label,prediction`` lines, counted as they come back."""
    path = _folder(spark)
    sinks.write_label_prediction(rule_predictions(spark, sf_dir), path)
    line = F.split("value", ",")
    back = spark.read.text(path).select(F.get(line, F.lit(0)).cast("double").alias("label"), F.get(line, F.lit(1)).cast("double").alias("prediction"))
    return rounded(evaluate.confusion(back), RATIO_DIGITS)


@register("file_roc_curve")
def q_file_roc_curve(spark, sf_dir):
    """``x,y`` lines of a ROC curve."""
    path = _folder(spark)
    sinks.write_curve(evaluate.roc_points(evaluate.curve(fine_rule_predictions(spark, sf_dir), num_bins=100)), path, "x", "y")
    line = F.split("value", ",")
    return rounded(spark.read.text(path).select(F.get(line, F.lit(0)).cast("double").alias("x"), F.get(line, F.lit(1)).cast("double").alias("y")), RATIO_DIGITS)

"""Session construction and the few settings every job relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the results depend on: UTC so epoch <-> date conversions are
# the same everywhere, ANSI on (errors instead of silent NULLs), AQE on so
# joins and shuffle partition counts are re-planned from runtime sizes.
CORE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "hotsets", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the core settings applied.

    On a cluster, leave ``master`` unset and let spark-submit decide; size
    ``shuffle_partitions`` so one partition of the largest shuffle fits in
    executor memory (AQE coalesces the small ones at runtime).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(CORE_CONF)
    # remove checkpoint files once no DataFrame refers to them any more
    conf["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    apply_core_conf(spark)
    ensure_checkpoint_dir(spark)
    return spark


def apply_core_conf(spark: SparkSession) -> None:
    """Pin the runtime SQL settings on an existing session (idempotent)."""
    for k, v in CORE_CONF.items():
        if k == "spark.ui.enabled":
            continue
        spark.conf.set(k, v)


def fresh_session(spark: SparkSession) -> SparkSession:
    """Another session of the same application with the same settings and its own state."""
    fresh = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            fresh.conf.set(k, v)
    apply_core_conf(fresh)
    return fresh


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint folder, setting one only when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset (local tests) do we set ``fallback``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        # a machine-local folder would be lost with its executor
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...) "
                           "before running jobs that checkpoint")
    sc.setCheckpointDir(fallback or os.path.join(os.environ.get("TMPDIR", "/tmp"), "hotsets-checkpoints"))
    return sc.getCheckpointDir()

"""End-to-end: domain files written from the sf0.001 tables, read back
through the registry, both study stages run from files."""

import os

import pytest
from pyspark.sql import functions as F

from hotsets import schemas
from hotsets.operators.accesslog import clean_accesses
from hotsets.operators.weekly import access_popularity
from hotsets.plans import study
from hotsets.sources import adapters, readers
from hotsets.sources.registry import Registry
from tests.conftest import SF_SMALL


def _in_schema_order(df, schema):
    cols = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def test_study_from_files(spark, tmp_out):
    src = os.path.join(tmp_out, "src")
    raw = adapters.access_raw(spark, SF_SMALL).withColumn(
        "read_bytes_at_close", F.floor(F.col("read_bytes_at_close")).cast("long"))
    access = _in_schema_order(raw, schemas.ACCESS_RAW).drop("_corrupt_record")
    access.write.json(os.path.join(src, "xrootd", "2015", "08", "01"))
    with open(os.path.join(src, "xrootd", "2015", "08", "01", "broken.json"), "w") as f:
        f.write('{"end_time": 1438387205, "file_lfn": "1", \n')
    catalog = _in_schema_order(adapters.file_catalog(spark, SF_SMALL), schemas.FILE_CATALOG)
    catalog.write.csv(os.path.join(src, "catalog"))
    snaps = _in_schema_order(adapters.replica_snapshots(spark, SF_SMALL), schemas.REPLICA_SNAPSHOTS)
    snaps.write.csv(os.path.join(src, "replicas", "time=2015-08-01"))
    adapters.jobs(spark, SF_SMALL).write.parquet(os.path.join(src, "jobs", "year=2015"))

    reg = (Registry(src)
           .add("access_log", "json", schemas.ACCESS_RAW, "xrootd/*/*/*")
           .add("file_catalog", "csv", schemas.FILE_CATALOG, "catalog")
           .add("replica_snapshots", "csv", schemas.REPLICA_SNAPSHOTS, "replicas/time=*", base_path="replicas")
           .add("jobs", "parquet", schemas.JOBS, "jobs/year=*"))
    out = os.path.join(tmp_out, "out")
    with pytest.raises(ValueError, match="analyses"):
        study.build_tables(spark, reg, out)
    written = study.build_tables(spark, reg, out, optional=("analyses", "dataset_catalog"))
    assert {"access_clean", "popularity", "jobs_popularity", "replicas", "histogram_users"} <= set(written)

    # weekly table from files == the same job on the in-memory frames
    want = access_popularity(clean_accesses(_in_schema_order(raw, schemas.ACCESS_RAW)), catalog)
    got = readers.read_popularity(spark, written["popularity"])
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    norm = lambda df: sorted((tuple(round(v, 4) if isinstance(v, float) else v for v in r)
                              for r in df.collect()), key=key)
    assert norm(got) == norm(want)
    assert readers.read_access_clean(spark, written["access_clean"]).count() == \
        clean_accesses(_in_schema_order(raw, schemas.ACCESS_RAW)).count()

    # stage 2: training year and a later week as separate files
    weekly = readers.read_popularity(spark, written["popularity"])
    weekly.filter("week <= 40").write.csv(os.path.join(tmp_out, "year"))
    weekly.filter("week > 40").write.csv(os.path.join(tmp_out, "week"))
    res = study.train_and_score(spark, os.path.join(tmp_out, "year"), os.path.join(tmp_out, "week"),
                                os.path.join(tmp_out, "ml"), metric="readbytes", threshold=50000)
    n_week = weekly.filter("week > 40").count()
    assert spark.read.text(res["predictions"]).count() == n_week
    m = {r["metric"]: float(r["value"]) for r in spark.read.option("header", True).csv(res["metrics"]).collect()}
    assert m["n"] == n_week
    assert m["tp"] + m["tn"] + m["fp"] + m["fn"] == n_week
    assert 0.0 <= m["area_under_roc"] <= 1.0 and "rmse" in m and "f1" in m
    assert res["predictions"].endswith("RF_readbytes_50000_week1")
    for name in ("roc", "pr", "precision", "recall", "f1", "f0_5", "held_out_roc", "held_out_pr", "held_out_metrics"):
        assert spark.read.text(res[name]).count() > 0
    assert len(spark.read.csv(res["roc"]).columns) == 2


def test_cli_build_on_production_layout(spark, tmp_out, capsys):
    """Default folder layout; sources without files are an error unless named as optional."""
    import json
    root = os.path.join(tmp_out, "root")
    raw = adapters.access_raw(spark, SF_SMALL).withColumn(
        "read_bytes_at_close", F.round(F.col("read_bytes_at_close")).cast("long"))
    _in_schema_order(raw, schemas.ACCESS_RAW).drop("_corrupt_record").write.json(
        os.path.join(root, "xrootd", "2015", "08", "01"))
    _in_schema_order(adapters.file_catalog(spark, SF_SMALL), schemas.FILE_CATALOG).write.csv(
        os.path.join(root, "catalog"))
    out = os.path.join(tmp_out, "cli_out")
    with pytest.raises(FileNotFoundError, match="replica_snapshots"):
        study.main(["build", root, out, "--optional", "jobs", "analyses", "dataset_catalog"])
    study.main(["build", root, out, "--optional", "jobs", "analyses", "dataset_catalog", "replica_snapshots"])
    res = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert "popularity" in res and "jobs_popularity" not in res and "replicas" not in res
    assert readers.read_popularity(spark, res["popularity"]).count() > 0


def test_raw_log_is_scanned_once_and_counted(spark, tmp_out):
    """Rows, malformed lines and unreadable numbers come from the job that cleans the log."""
    root = os.path.join(tmp_out, "root")
    folder = os.path.join(root, "xrootd", "2015", "08", "01")
    good = '{"start_time": 1438387205, "end_time": 1438387305, "read_bytes_at_close": %s, "file_lfn": "f%d", "file_size": %s}\n'
    os.makedirs(folder)
    with open(os.path.join(folder, "log.json"), "w") as f:
        f.writelines(good % ("100" if i % 4 else '"x"', i, "7.5" if i % 2 else '"big"') for i in range(20))
        f.write('{"start_time": 1, \n{"end\n')
    os.makedirs(os.path.join(root, "catalog"))
    cat = spark.createDataFrame([("/a/b-c/d", f"f{i}", 1.0) for i in range(20)], "dataset_name string, file_lfn string, filesize double")
    _in_schema_order(cat, schemas.FILE_CATALOG).write.csv(os.path.join(root, "catalog", "x"))
    from hotsets.sources.registry import default_registry
    out = study.build_tables(spark, default_registry(root), os.path.join(tmp_out, "out"), optional=("jobs", "analyses", "dataset_catalog", "replica_snapshots"))
    counts = dict(r for r in spark.read.csv(out["access_counts"], schema="t string, n long").collect())
    assert counts == {"access_raw": 22, "access_corrupt": 2, "access_clean": 15}
    bad = dict(r for r in spark.read.csv(out["access_unreadable"], schema="t string, n long").collect())
    assert bad == {"read_bytes_at_close": 5, "file_size": 10}
    # all that reads the raw log is one scan
    from pyspark.sql import Observation
    from hotsets.sources import handoff
    other = handoff.beside(spark)
    log = default_registry(root).read(other, "access_log", Observation("again"))
    plan = clean_accesses(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1 and "CollectMetrics" in plan

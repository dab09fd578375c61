"""End-to-end runs over files: the two stages of a popularity study.

Stage 1 (``build_tables``): read the access log, file catalog, job records
and replica snapshots named in a ``Registry``; write the cleaned accesses,
the weekly tables of both sources, the replication factors and the
histograms.  Stage 2 (``train_and_score``): read a training year and a new
week of the weekly table, label, balance, split, train, score the week and
write predictions and metrics.

Every intermediate goes through a file (as the weekly table is written
once and read by the training job), so each stage restarts from files
after a failure and no step reaches back into the raw logs.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Observation, SparkSession, functions as F

from hotsets.ml import models
from hotsets.operators import evaluate, features, profile, replicas, sampling
from hotsets.operators.accesslog import clean_accesses
from hotsets.operators.weekly import access_popularity, jobs_popularity
from hotsets.schemas import METRICS
from hotsets.sources import readers, sinks
from hotsets.sources.handoff import beside, hand_off, owning
from hotsets.sources.registry import Registry


def _j(*parts: str) -> str:
    return os.path.join(*parts) if "://" not in parts[0] else "/".join(p.strip("/") for p in parts)


def _source(spark: SparkSession, registry: Registry, name: str, optional: tuple[str, ...], observation: Observation | None = None):
    """The source as a DataFrame.  One that is missing or matches no file is an
    error, or None if it is named as optional."""
    if name in optional and (name not in registry.names() or not registry.has_files(spark, name)):
        return None
    if name not in registry.names():
        raise ValueError(f"source {name!r} is not registered; name it in optional= to go on without it")
    try:
        return registry.read(spark, name, observation)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(f"source {name!r} has no files at {registry.path(name)}; name it in optional= to go on without it") from e
        raise


def build_tables(spark: SparkSession, registry: Registry, out_dir: str, access_source: str = "aaa",
                 mode: str = sinks.DEFAULT_MODE, optional: tuple[str, ...] = ()) -> dict[str, str]:
    """Stage 1.  Returns the written paths by table name.  All sources of the
    study must be there, but for those named in ``optional``: their tables
    are left out.  ``access_source``: the access log of that name is read
    (``aaa``: ``access_log``, others: ``access_log_<name>``), and the tables made from it carry it."""
    with owning(spark, "study-build") as owned:
        return _build_tables(owned, registry, out_dir, access_source, mode, optional)


def _build_tables(spark: SparkSession, registry: Registry, out_dir: str, access_source: str,
                  mode: str, optional: tuple[str, ...]) -> dict[str, str]:
    written: dict[str, str] = {}

    def put(df, name: str, folder: str | None = None) -> str:
        written[name] = _j(out_dir, folder or name)
        sinks.write_csv(df, written[name], mode)
        return written[name]

    # every source is resolved before anything is written
    observed = Observation("access_log")
    log_name = "access_log" if access_source == "aaa" else f"access_log_{access_source}"
    log = _source(beside(spark), registry, log_name, optional, observed)
    catalog, jobs, snap, analyses, datasets = (
        _source(spark, registry, n, optional) for n in ("file_catalog", "jobs", "replica_snapshots", "analyses", "dataset_catalog"))

    if log is not None and catalog is not None:
        # the one scan of the raw log: what it reads, rejects and writes is counted on the way
        kept = Observation("access_clean")
        clean_path = put(clean_accesses(log).observe(kept, F.count(F.lit(1)).alias("n")), "access_clean", f"access_clean_{access_source}")
        counts = {"access_clean": kept.get["n"]}
        if registry.format(log_name) == "json":
            found = dict(observed.get)
            counts |= {"access_raw": found.pop(readers.OBSERVED_ROWS), "access_corrupt": found.pop(readers.OBSERVED_CORRUPT)}
            put(spark.createDataFrame([(f, n) for f, n in found.items() if n], "field string, n_rows long"), "access_unreadable")
        put(spark.createDataFrame(sorted(counts.items()), "table_name string, n_rows long"), "access_counts")
        # the weekly job reads the cleaned table back: one scan of the raw log
        clean = readers.read_access_clean(spark, clean_path)
        pop = access_popularity(clean, catalog)
        pop_path = _j(out_dir, sinks.popularity_output_dir(access_source))
        sinks.write_popularity(pop, pop_path, "csv", mode)
        written["popularity"] = pop_path
        # five histograms read the weekly table: parse the text once, keep
        # the rows (spilling to disk if needed), release them afterwards
        weekly = readers.read_popularity(spark, pop_path).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # all metrics in one pass; the result has a few dozen rows for each
            together = hand_off(profile.log_histograms(weekly, METRICS))
            for metric in METRICS:
                one = together.where(F.col("metric") == metric).select(F.col("bucket").alias(metric), "occurrences")
                put(profile.ordered_histogram(one, metric), f"histogram_{metric}")
            put(profile.ordered_histogram(profile.user_histogram(weekly), "rows_per_user"), "histogram_users")
        finally:
            weekly.unpersist()

    if jobs is not None:
        p = _j(out_dir, sinks.popularity_output_dir("crab"))
        sinks.write_popularity(jobs_popularity(jobs), p, "csv", mode)
        written["jobs_popularity"] = p

    if snap is not None:
        path = put(replicas.replication_factor(snap), "replicas")
        factors = readers.read_csv(spark, path, _replica_schema())
        put(profile.ordered_histogram(profile.log_histogram(factors, "replicas"), "replicas"), "histogram_replicas")

    if analyses is not None:
        put(profile.conference_groups(analyses), "analyses")
    if datasets is not None:
        put(profile.table_counts({"dataset_catalog": datasets}), "dataset_count")
    return written


def _replica_schema():
    from pyspark.sql.types import LongType, StringType, StructField, StructType
    return StructType([StructField("replicas", LongType()), StructField("dataset_name", StringType())])


def train_and_score(spark: SparkSession, train_path: str, week_path: str, out_dir: str,
                    model: str = "random_forest", metric: str = features.DEFAULT_LABEL_METRIC,
                    threshold: float = features.DEFAULT_THRESHOLD, num_bins: int = 0,
                    mode: str = sinks.DEFAULT_MODE, top_n: int | None = None) -> dict[str, str]:
    """Stage 2.  Trains ``model`` on the training part of the balanced year and
    scores the new week and the held-out part.  Writes the week's
    ``label,prediction`` lines and, for both, the ROC and precision-recall
    curves, precision, recall, F1 and F0.5 by threshold, and the metrics as
    (metric, value) rows.  Curves have a point per score; ``num_bins`` thins them out."""
    with owning(spark, "study-train") as owned:
        return _train_and_score(owned, train_path, week_path, out_dir, model, metric, threshold, num_bins, mode, top_n)


def _train_and_score(spark: SparkSession, train_path: str, week_path: str, out_dir: str, model: str, metric: str,
                     threshold: float, num_bins: int, mode: str, top_n: int | None) -> dict[str, str]:
    # the year is read for the vocabulary and for the sample: parse the text once
    year = features.with_label(readers.read_popularity(spark, train_path), metric, threshold).persist(StorageLevel.MEMORY_AND_DISK)
    week = features.with_label(readers.read_popularity(spark, week_path), metric, threshold)
    try:
        train, held_out = sampling.train_test_split(sampling.balanced_sample(year))
        scored = week.withColumn("_held_out", F.lit(False)).unionByName(held_out.withColumn("_held_out", F.lit(True)))
        preds = hand_off(models.train_and_score(model, train, scored, top_n, vocab_rows=year), ["_held_out"])
    finally:
        year.unpersist()

    tag = sinks.predictions_output_dir(models.MODEL_TAGS.get(model, model), metric, _num(threshold))
    written = {"predictions": _j(out_dir, "scored", tag)}
    sinks.write_label_prediction(preds.where("not _held_out"), written["predictions"], mode)
    for part, rows in (("", preds.where("not _held_out")), ("held_out_", preds.where("_held_out"))):
        crv = hand_off(evaluate.curve(rows, num_bins=num_bins))
        for name, table, columns in (
                ("roc", evaluate.roc_points(crv), ["x", "y"]), ("pr", evaluate.pr_points(crv), ["x", "y"]),
                ("precision", crv, ["threshold", "precision"]), ("recall", crv, ["threshold", "recall"]),
                ("f1", crv, ["threshold", "f1"]), ("f0_5", crv, ["threshold", "f0_5"])):
            written[part + name] = _j(out_dir, part + name, tag)
            sinks.write_curve(table, written[part + name], *columns, mode)
        written[part + "metrics"] = _j(out_dir, part + "metrics", tag)
        evaluate.metrics(rows, crv).write.mode(mode).option("header", True).csv(written[part + "metrics"])
    return written


def _num(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)



def main(argv: list[str] | None = None) -> None:
    """``spark-submit -m``-style entry:

    python -m hotsets.plans.study build ROOT OUT
    python -m hotsets.plans.study train YEAR_CSV WEEK_CSV OUT [--model M] [--metric X] [--threshold T]
    """
    import argparse
    import json

    from hotsets.session import build_session
    from hotsets.sources.registry import default_registry

    ap = argparse.ArgumentParser(prog="hotsets.plans.study")
    sub = ap.add_subparsers(dest="stage", required=True)
    b = sub.add_parser("build", help="stage 1: weekly tables, replicas, histograms")
    b.add_argument("root")
    b.add_argument("out")
    b.add_argument("--access-source", default="aaa", help="which access log to read: aaa or eos")
    b.add_argument("--optional", nargs="*", default=[], help="sources to go on without if they have no files")
    t = sub.add_parser("train", help="stage 2: train on a year, score a new week")
    t.add_argument("year")
    t.add_argument("week")
    t.add_argument("out")
    t.add_argument("--model", default="random_forest", choices=models.MODEL_NAMES)
    t.add_argument("--metric", default=features.DEFAULT_LABEL_METRIC)
    t.add_argument("--threshold", type=float, default=features.DEFAULT_THRESHOLD)
    t.add_argument("--top-n", type=int, default=None,
                   help="keep the N most frequent values per feature, the rest share one id")
    a = ap.parse_args(argv)
    spark = build_session(app_name=f"hotsets-study-{a.stage}")
    if a.stage == "build":
        res = build_tables(spark, default_registry(a.root), a.out, a.access_source, optional=tuple(a.optional))
    else:
        res = train_and_score(spark, a.year, a.week, a.out, a.model, a.metric, a.threshold,
                              top_n=a.top_n)
    print(json.dumps(res))


if __name__ == "__main__":
    main()

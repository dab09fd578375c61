"""Bucketed tables, repeatable weekly loads, vocabularies that grow."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from hotsets.operators import features, profile
from hotsets.operators.weekly import access_popularity
from hotsets.plans.domain import Domain
from hotsets.plans.output import rounded
from hotsets.sources import handoff
from hotsets.sources.buckets import co_located, write_bucketed
from hotsets.sources.sinks import load_weeks
from tests.conftest import SF_SMALL, rows


def names():
    tag = uuid.uuid4().hex
    return f"acc_{tag}", f"cat_{tag}"


def test_bucketed_weekly_join_moves_nothing(spark):
    with handoff.owning(spark, "buckets") as owned:
        d, (a, c) = Domain(owned, SF_SMALL), names()
        early, late = d.access_clean.where("cts % 2 = 0"), d.access_clean.where("cts % 2 = 1")
        write_bucketed(early, a, "file_lfn", 4)
        accesses = write_bucketed(late, a, "file_lfn", 4, mode="append")  # a later day goes into the same buckets
        catalog = write_bucketed(d.file_catalog, c, "file_lfn", 4)
        pop = access_popularity(*co_located(accesses, catalog))
        plan = pop._jdf.queryExecution().executedPlan().toString()
        # one exchange, by dataset, above the join; none below it
        assert plan.count("Exchange ") == 1 and plan.index("Exchange ") < plan.index("SortMergeJoin")
        assert "SelectedBucketsCount: 4 out of 4" in plan
        want = rounded(Domain(spark, SF_SMALL).popularity)
        assert rows(rounded(pop).select(want.columns)) == rows(want)
        assert spark.catalog.tableExists(a)
    assert not spark.catalog.tableExists(a) and not spark.catalog.tableExists(c)
    assert [t for t in handoff.left(spark) if t.startswith("buckets-")] == []


def files(path):
    return {os.path.join(f, x): os.stat(os.path.join(f, x)).st_mtime_ns for f, _, xs in os.walk(path) for x in xs if x.startswith("part-")}


WEEKLY = "year int, week int, dataset_name string, numaccesses double"


def test_repeated_load_replaces_its_weeks_only(spark, tmp_out):
    path = os.path.join(tmp_out, "weekly")
    first = spark.createDataFrame([(2015, w, f"d{i}", 1.0) for w in range(1, 6) for i in range(3)] + [(2016, 1, "d0", 1.0)], WEEKLY)
    load_weeks(first, path)
    before = files(path)
    again = spark.createDataFrame([(2015, 3, "d0", 2.0), (2015, 3, "new", 2.0), (2016, 2, "d9", 2.0)], WEEKLY)
    for _ in range(2):  # repeated: no row twice
        load_weeks(again, path)
        got = spark.read.schema(WEEKLY).parquet(path)
        assert rows(got.where("year = 2015 and week = 3"), "dataset_name", "numaccesses") == [("d0", 2.0), ("new", 2.0)]
        assert got.count() == 15 + 1 - 3 + 2 + 1
    after = files(path)
    others = {f for f in before if "year=2015/week=3/" not in f}
    assert len(others) < len(before) and {f: after.get(f) for f in others} == {f: before[f] for f in others}


def test_failed_load_changes_nothing(spark, tmp_out):
    path = os.path.join(tmp_out, "weekly")
    load_weeks(spark.createDataFrame([(2015, w, "d", 1.0) for w in range(1, 4)], WEEKLY), path)
    before = files(path)
    bad = spark.range(0, 200, numPartitions=4).select(F.lit(2015).alias("year"), (F.col("id") % 3 + 1).cast("int").alias("week"), F.lit("x").alias("dataset_name"),
                                                      F.when(F.col("id") == 150, F.raise_error(F.lit("lost")).cast("double")).otherwise(2.0).alias("numaccesses"))
    with pytest.raises(Exception, match="lost"):
        load_weeks(bad, path)
    assert files(path) == before
    assert rows(spark.read.schema(WEEKLY).parquet(path), "week", "numaccesses") == [(1, 1.0), (2, 1.0), (3, 1.0)]


def test_ids_never_move_between_versions(spark):
    week1 = spark.createDataFrame([("m", "x"), ("b", None), ("m", "y")], "a string, b string")
    week2 = spark.createDataFrame([("a", "x"), ("z", "w"), (None, "y"), ("b", "q")], "a string, b string")
    v1 = features.first_version(features.vocabulary(week1, ["a", "b"])).cache()
    v2 = v1.unionByName(features.extend_vocabulary(v1, week2, 2, ["a", "b"])).cache()
    assert rows(features.at_version(v2, 1)) == rows(v1.drop("version"))
    assert {(r["feature"], r["value"]): (r["idx"], r["version"]) for r in v2.collect()} == {
        ("a", "b"): (0, 1), ("a", "m"): (1, 1), ("b", None): (0, 1), ("b", "x"): (1, 1), ("b", "y"): (2, 1),
        ("a", None): (2, 2), ("a", "a"): (3, 2), ("a", "z"): (4, 2), ("b", "q"): (3, 2), ("b", "w"): (4, 2)}
    assert features.vocabulary_sizes(features.at_version(v2, 1)) == {"a": 2, "b": 3}
    assert features.vocabulary_sizes(features.at_version(v2, 2)) == {"a": 5, "b": 5}
    assert features.extend_vocabulary(v2, week2, 3, ["a", "b"]).count() == 0  # a repeated load adds nothing
    # what version 1 encoded, version 2 encodes alike
    for v in (1, 2):
        encoded = features.encode(week1, features.at_version(v2, v), ["a", "b"])
        assert rows(encoded, "f_a", "f_b") == [(0, 0), (1, 1), (1, 2)]


def test_all_histograms_in_one_pass(spark):
    pop = Domain(spark, SF_SMALL).popularity
    metrics = ["dataset_size", "numaccesses", "proctime", "readbytes"]
    together = profile.log_histograms(pop, metrics)
    plan = together._jdf.queryExecution().executedPlan().toString()
    alone = profile.log_histogram(pop, metrics[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == alone.count("FileScan")
    for m in metrics:
        assert rows(together.where(F.col("metric") == m), "bucket", "occurrences") == rows(profile.log_histogram(pop, m), m, "occurrences")


def test_buckets_follow_the_rows(spark, monkeypatch):
    from hotsets.plans.queries import q_popularity_weekly_bucketed
    from hotsets.sources import buckets
    assert [buckets.buckets_for(n, 16) for n in (0, 16_000_000, 16_000_001, 111_000_000)] == [16, 16, 32, 128]
    monkeypatch.setattr(buckets, "ROWS_PER_BUCKET", 100)
    with handoff.owning(spark, "buckets") as owned:
        got = q_popularity_weekly_bucketed(owned, SF_SMALL)
        assert "SelectedBucketsCount: 32 out of 32" in got._jdf.queryExecution().executedPlan().toString()
        assert rows(got) == rows(rounded(Domain(spark, SF_SMALL).popularity))

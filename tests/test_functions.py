import math

import duckdb
from pyspark.sql import functions as F

from hotsets.functions import dataset_parts, log_bucket, unit_hash, week_of_day_string, week_of_epoch_ms
from hotsets.functions.hashing import row_key


def test_dataset_parts_edge_cases(spark):
    names = ["/a/b-v1/T", "/a/b/T", "/a", None, "a/b/c", "/p/era-v2-x/AOD"]
    df = spark.createDataFrame([(n,) for n in names], "dataset_name string")
    got = {r["dataset_name"]: tuple(r[1:]) for r in df.select(
        "dataset_name", *[c.alias(k) for k, c in dataset_parts("dataset_name").items()]).collect()}
    assert got["/a/b-v1/T"] == ("a", "b-v1", "b", "v1", "T")
    assert got["/a/b/T"] == ("a", "b", "b", None, "T")
    assert got["/a"] == ("a", None, None, None, None)
    assert got[None] == (None, None, None, None, None)
    assert got["a/b/c"] == ("b", "c", "c", None, None)
    assert got["/p/era-v2-x/AOD"] == ("p", "era-v2-x", "era", "v2", "AOD")


def test_log_bucket_null_for_non_positive(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (None,), (-5.0,), (3.0,), (1e6,)], "x double")
    got = [r[0] for r in df.select(log_bucket("x")).collect()]
    assert got == [None, 0, None, None, 2, math.ceil(math.log(1e6))]


def test_week_53_and_ms_before_midnight(spark):
    df = spark.createDataFrame([("2015/12/31",), ("2016/01/01",), ("2016/01/04",)], "d string")
    assert [r[0] for r in df.select(week_of_day_string("d")).collect()] == [53, 53, 1]
    # 2016-01-03 23:59:59.999 UTC is still ISO week 53 of 2015
    ms = spark.createDataFrame([(1451865599999,), (1451865600000,)], "t long")
    assert [r[0] for r in ms.select(week_of_epoch_ms("t")).collect()] == [53, 1]


def test_unit_hash_matches_sql_engine(spark):
    keys = [f"k{i}|x" for i in range(50)] + ["", "é|ü"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["u"] for r in df.select("k", unit_hash(F.col("k"), "s:").alias("u")).collect()}
    con = duckdb.connect()
    for k in keys:
        want = con.execute("SELECT CAST(('0x' || substr(md5('s:' || ?), 1, 8)) AS BIGINT) / 4294967296.0",
                           [k]).fetchone()[0]
        assert got[k] == want
        assert 0.0 <= got[k] < 1.0


def test_row_key_marks_nulls(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "a", None), (1, "-", "a")], "w int, a string, b string")
    assert [r[0] for r in df.select(row_key(["w", "a", "b"])).collect()] == ["=1|-|=a", "=1|=a|-", "=1|=-|=a"]



def test_dataset_parts_property(spark):
    """Random names with '/' and '-' against a plain-Python model of the
    split-and-take rules (missing element -> NULL)."""
    from hypothesis import given, settings, strategies as st

    def model(name):
        def get(xs, i):
            return xs[i] if 0 <= i < len(xs) else None
        p = name.split("/")
        proc = get(p, 2)
        q = proc.split("-") if proc is not None else []
        return (get(p, 1), proc, get(q, 0) if proc is not None else None,
                get(q, 1) if proc is not None else None, get(p, 3))

    @settings(max_examples=3, deadline=None)
    @given(st.lists(st.text(alphabet="ab/-", max_size=12), min_size=20, max_size=40))
    def check(names):
        df = spark.createDataFrame([(n,) for n in names], "dataset_name string")
        got = {r[0]: tuple(r[1:]) for r in df.select(
            "dataset_name", *[c.alias(k) for k, c in dataset_parts("dataset_name").items()]).collect()}
        for n in names:
            assert got[n] == model(n), n

    check()

import random

import pytest
from pyspark.sql import Window, functions as F

from hotsets.operators import features
from hotsets.operators.indexing import ordered_index, running_sum
from tests.conftest import rows


def test_label_is_strict(spark):
    df = spark.createDataFrame([(50.0,), (51.0,), (None,), (0.0,)], "numaccesses double")
    got = [r["label"] for r in features.with_label(df).collect()]
    assert got == [0.0, 1.0, 0.0, 0.0]


@pytest.mark.parametrize("local", [False, True])
def test_ordered_index_matches_dense_rank(spark, local):
    rnd = random.Random(7)
    data = [(rnd.choice(["a", "b", "c", None]), f"v{rnd.randint(0, 5000):05d}") for _ in range(3000)]
    df = spark.createDataFrame(data, "g string, v string").distinct()
    known = df.count() if local else None
    got = ordered_index(df, "g", "v", "idx", num_partitions=7)
    want = df.withColumn("idx", F.dense_rank().over(Window.partitionBy("g").orderBy("v")) - 1)
    assert rows(got, "g", "v", "idx") == rows(want, "g", "v", "idx")
    # descending, no group
    d2 = df.select("v").distinct()
    got2 = ordered_index(d2, None, "v", "i", descending=True, num_partitions=5)
    want2 = d2.withColumn("i", F.row_number().over(Window.orderBy(F.col("v").desc())) - 1)
    assert rows(got2, "v", "i") == rows(want2, "v", "i")


@pytest.mark.parametrize("local", [False, True])
def test_running_sum_matches_window(spark, local):
    rnd = random.Random(3)
    data = [(float(i), rnd.randint(0, 9), rnd.randint(0, 9)) for i in rnd.sample(range(100000), 2000)]
    df = spark.createDataFrame(data, "t double, a long, b long")
    got = running_sum(df, "t", ["a", "b"], descending=True, num_partitions=6,
                      known_rows=2000 if local else None)
    w = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("t", "a", "b", F.sum("a").over(w).alias("cum_a"), F.sum("b").over(w).alias("cum_b"))
    assert rows(got, "t", "cum_a", "cum_b") == rows(want, "t", "cum_a", "cum_b")


POP = "week int, primary_dataset string, processed_dataset string, acquisition_era string, " \
      "processing_version string, datatier string, client_domain string, server_domain string, " \
      "server_site string, user_protocol string, dataset_size double, label double"


def _pop(spark, sites):
    return spark.createDataFrame(
        [(53 if i == 0 else 1 + i % 52, "P", "e-v", "e", "v", "T", None if i == 1 else "c",
          "d", s, "xrootd", float(i), float(i % 2)) for i, s in enumerate(sites)], POP)


def test_vocabulary_sorted_ids_and_null_category(spark):
    train = _pop(spark, ["b", "a", "c", "a"])
    v = features.vocabulary(train, ["server_site", "client_domain"])
    got = rows(v, "feature", "value", "idx")
    assert ("server_site", "a", 0) in got and ("server_site", "c", 2) in got
    # NULL is a category: it sorts first
    assert ("client_domain", None, 0) in got and ("client_domain", "c", 1) in got


@pytest.mark.parametrize("mode,unseen_id", [("keep", 3), ("zero", 0)])
def test_encode_unseen(spark, mode, unseen_id):
    train = _pop(spark, ["b", "a", "c"])
    week = _pop(spark, ["a", "zz", "c"])
    vocab = features.fit_vocabulary(train, features.FEATURE_CATEGORIES)
    enc = features.encode(features.with_week_feature(week), vocab, unseen=mode)
    got = [r["f_server_site"] for r in enc.orderBy("dataset_size").collect()]
    assert got == [0, unseen_id, 2]
    weeks = [r["f_week"] for r in enc.orderBy("dataset_size").collect()]
    assert weeks[0] == 52  # week 53 -> id 52 (fits arity 53)


def test_encode_error_on_unseen(spark):
    train = _pop(spark, ["b", "a"])
    week = _pop(spark, ["zz"])
    vocab = features.fit_vocabulary(train, features.FEATURE_CATEGORIES)
    with pytest.raises(Exception, match="not in vocabulary"):
        features.encode(week, vocab, unseen="error").collect()


def test_top_n_vocabulary_keeps_most_frequent(spark, monkeypatch):
    from hotsets.operators import indexing
    monkeypatch.setattr(indexing, "ROWS_PER_RANGE", 2)  # several ranges
    sites = ["a"] * 5 + ["b"] * 1 + ["c"] * 3 + ["d"] * 3 + ["e"] * 2
    df = _pop(spark, sites)
    v = features.vocabulary(df, ["server_site"], top_n=3)
    # c and d tie on 3: both kept ahead of e; ids follow the sorted value
    assert rows(v, "value", "idx") == [("a", 0), ("c", 1), ("d", 2)]
    enc = features.encode(df, features.fit_vocabulary(df, ["server_site"], top_n=3), ["server_site"],
                          unseen="keep")
    other = {r["server_site"]: r["f_server_site"] for r in enc.collect()}
    assert other["b"] == other["e"] == 3 and other["a"] == 0


def test_ordered_index_property(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.integers(0, 300)), min_size=1, max_size=300),
           st.integers(min_value=1, max_value=9), st.booleans(), st.booleans())
    def check(pairs, parts, descending, local):
        data = sorted(set(pairs), key=lambda t: (t[0] is not None, t[0] or "", t[1]))
        df = spark.createDataFrame(data, "g string, v long")
        got = ordered_index(df, "g", "v", "idx", descending=descending, num_partitions=parts)
        want = {}
        for g in {d[0] for d in data}:
            vs = sorted((d[1] for d in data if d[0] == g), reverse=descending)
            want.update({(g, v): i for i, v in enumerate(vs)})
        assert {(r["g"], r["v"]): r["idx"] for r in got.collect()} == want

    check()


def test_encode_with_shuffled_vocabularies(spark):
    """The ids do not depend on the join strategy; NULL is a value like any other."""
    df = _pop(spark, ["b", "a", None, "a", "c"])
    vocab = features.fit_vocabulary(df, ["server_site", "client_domain"])
    cols = ["server_site", "client_domain"]
    plain = features.encode(df, vocab, cols)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = features.encode(df, vocab, cols)
        out = ["dataset_size", "f_server_site", "f_client_domain"]
        assert rows(shuffled, *out) == rows(plain, *out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unseen_values_are_named_together_in_one_check(spark):
    """One check after the joins, not a message in each: all values of a row without an id are named."""
    seen = spark.createDataFrame([("a", "x", None)], "p string, q string, r string")
    vocab = features.vocabulary(seen, ["p", "q", "r"]).cache()
    known = features.encode(seen, vocab, ["p", "q", "r"], unseen="error")
    assert [tuple(r) for r in known.select("f_p", "f_q", "f_r").collect()] == [(0, 0, 0)]
    assert known._jdf.queryExecution().optimizedPlan().toString().count("raise_error") == 1
    other = spark.createDataFrame([("a", None, "z")], "p string, q string, r string")
    with pytest.raises(Exception, match="not in vocabulary of q: NULL, r: z"):
        features.encode(other, vocab, ["p", "q", "r"], unseen="error").collect()

from pyspark.sql import functions as F

from hotsets.operators import sampling

KEYS = ["week", "dataset_name"]


def _df(spark, n=20000):
    return spark.range(n).select(
        (F.col("id") % 53 + 1).cast("int").alias("week"),
        F.concat(F.lit("/d/"), F.col("id").cast("string")).alias("dataset_name"),
        F.when(F.col("id") % 5 == 0, 1.0).otherwise(0.0).alias("label"))


def test_balanced_sample_repeatable_and_sized(spark):
    df = _df(spark)
    a = sampling.balanced_sample(df, key_cols=KEYS)
    b = sampling.balanced_sample(df, key_cols=KEYS)
    assert sorted(r[0] for r in a.select("dataset_name").collect()) == \
        sorted(r[0] for r in b.select("dataset_name").collect())
    pos = a.filter("label = 1").count()
    neg = a.filter("label = 0").count()
    assert pos == 4000
    assert abs(neg / 16000 - 0.15) < 0.02


def test_split_disjoint_complete_and_independent(spark):
    df = sampling.balanced_sample(_df(spark), key_cols=KEYS)
    n = df.count()
    train, test = sampling.train_test_split(df, key_cols=KEYS)
    nt, ns = train.count(), test.count()
    assert nt + ns == n
    assert train.join(test, KEYS).count() == 0
    assert abs(nt / n - 0.7) < 0.03
    # kept negatives are not all in training (different salts)
    assert test.filter("label = 0").count() > 0


def test_unit_hash_split_is_row_local(spark):
    """A row's fate does not depend on the other rows or on partitioning."""
    from hypothesis import given, settings, strategies as st

    from hotsets.functions.hashing import row_key, unit_hash
    full = _df(spark, 3000)
    u_full = {r["dataset_name"]: r["u"] for r in full.select(
        "dataset_name", unit_hash(row_key(KEYS), "split:").alias("u")).collect()}

    @settings(max_examples=5, deadline=None)
    @given(st.integers(min_value=1, max_value=9), st.integers(min_value=0, max_value=2999))
    def check(parts, start):
        sub = full.filter(F.col("week") >= 0).repartition(parts).filter(
            F.col("dataset_name") >= F.lit(f"/d/{start}"))
        for r in sub.select("dataset_name", unit_hash(row_key(KEYS), "split:").alias("u")).collect():
            assert r["u"] == u_full[r["dataset_name"]]

    check()


def test_draws_sample_the_same_rows(spark):
    """Numbers kept as columns choose the rows that the keys choose."""
    df = spark.range(4000).selectExpr("cast(id % 50 as int) as week", "if(id % 7 = 0, null, concat('/d', id)) as dataset_name", "'c' as client_domain", "'u' as username",
                                      "'s' as server_domain", "'t' as server_site", "'x' as user_protocol", "cast(id % 3 = 0 as double) as label", "id")
    drawn = sampling.with_draws(df).select(*sampling.DRAWS, "label", "id")
    want = sampling.with_split(sampling.balanced_sample(df)).select("id", "split")
    got = sampling.with_split(sampling.balanced_sample(drawn, drawn="_balance"), drawn="_split").select("id", "split")
    assert want.count() > 1000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

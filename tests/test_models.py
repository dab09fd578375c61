import random

import pytest

from hotsets.ml import models, verify
from hotsets.operators import evaluate, sampling

POP = ("week int, dataset_name string, primary_dataset string, processed_dataset string, "
       "acquisition_era string, processing_version string, datatier string, client_domain string, "
       "username string, server_domain string, server_site string, user_protocol string, "
       "dataset_size double, label double")


def planted(spark, n=3000, seed=1):
    """Label decided by one category (site S1) and one numeric field."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        site = rnd.choice(["S0", "S1", "S2", "S3"])
        size = rnd.uniform(0, 100)
        label = 1.0 if (site == "S1" and size > 30) else 0.0
        out.append((rnd.randint(1, 53), f"/p{i}", rnd.choice(["P1", "P2"]), "e-v", "e", "v",
                    rnd.choice(["AOD", "RAW"]), rnd.choice(["c1", "c2"]), "u", "d", site, "xrootd",
                    size, label))
    return spark.createDataFrame(out, POP)


@pytest.mark.parametrize("name", ["random_forest", "decision_tree", "gbt", "logistic_regression"])
def test_models_beat_majority_on_planted_signal(spark, name):
    df = planted(spark)
    train, test = sampling.train_test_split(df, key_cols=["dataset_name"])
    preds = models.train_and_score(name, train, test)
    c = evaluate.confusion(preds).first()
    majority = max(test.filter("label = 1").count(), test.filter("label = 0").count()) / c["n"]
    acc = (c["tp"] + c["tn"]) / c["n"]
    assert set(r[0] for r in preds.select("prediction").distinct().collect()) <= {0.0, 1.0}
    if name in ("random_forest", "decision_tree", "gbt"):
        assert acc > majority + 0.05, (acc, majority)
    else:  # ids are numbers to a linear model: it sees the size only
        assert evaluate.areas(evaluate.curve(preds)).first()["area_under_roc"] > 0.55


def test_linear_models_run(spark):
    df = planted(spark, n=800)
    train, test = sampling.train_test_split(df, key_cols=["dataset_name"])
    for name in ("linear_svc", "linear_regression"):
        preds = models.train_and_score(name, train, test)
        assert preds.count() == test.count()


def test_categorical_metadata_and_bins(spark):
    df = planted(spark, n=200)
    tr, sc, arities = models.prepare(df, df)
    meta = tr.schema["features"].metadata["ml_attr"]
    nominal = meta["attrs"]["nominal"]
    assert {a["name"] for a in nominal} >= {"f_week", "f_server_site"}
    assert arities["f_week"] == 53 and arities["f_server_site"] == 5  # 4 sites + unseen bucket
    with pytest.raises(ValueError):
        models.estimator("kmeans")


def test_top_n_bounds_arity(spark):
    df = planted(spark, n=600)
    tr, sc, arities = models.prepare(df, df, top_n=2)
    assert arities["f_server_site"] == 3  # 2 kept sites + shared bucket
    preds = models.train_and_score("decision_tree", df, df, top_n=2)
    assert preds.count() == 600


def test_more_categories_than_training_rows_is_said_by_name(spark):
    df = planted(spark, n=600)
    from pyspark.sql import functions as F
    wide = df.withColumn("server_site", F.concat(F.lit("S"), F.monotonically_increasing_id() % 500))
    few = wide.limit(40)
    with pytest.raises(ValueError, match="f_server_site.*top_n"):
        models.train_and_score("decision_tree", few, wide, vocab_rows=wide)
    # with top_n it trains
    assert models.train_and_score("decision_tree", wide.limit(100), wide, top_n=10, vocab_rows=wide).count() == 600


def test_predictions_keep_row_keys(spark):
    df = planted(spark, n=300)
    preds = models.train_and_score("logistic_regression", df, df)
    assert {"week", "dataset_name", "server_site", "label", "prediction", "score"} <= set(preds.columns)
    assert preds.select("dataset_name").distinct().count() == 300


def test_one_hot_learns_what_ids_hide(spark):
    """A linear model sees a middle category only with a slot of its own; one coefficient per category."""
    df = planted(spark, n=2000)
    train, test = sampling.train_test_split(df, key_cols=["dataset_name"])
    area = {h: evaluate.areas(evaluate.curve(models.train_and_score("logistic_regression", train, test, one_hot=h))).first()["area_under_roc"] for h in (False, True)}
    assert area[True] > area[False] + 0.1 and area[True] > 0.9
    e = models.fit_encoding(train, one_hot=True)
    rows = e.vectors(train)
    assert rows.first()["features"].size == sum(e.arities.values()) + 1
    model = models.fit("logistic_regression", rows, e.arities)
    c = {(r["feature"], r["value"], r["unseen"]): r["coefficient"] for r in models.category_coefficients(model, e.arities, e.vocab).where("feature = 'server_site'").collect()}
    assert set(c) == {("server_site", s, False) for s in ("S0", "S1", "S2", "S3")} | {("server_site", None, True)}
    assert c["server_site", "S1", False] > max(v for k, v in c.items() if k[1] != "S1") and c["server_site", None, True] == 0
    # a value that was not there scores through the unseen slot
    from pyspark.sql import functions as F
    assert models.predict(model, e.vectors(test.withColumn("server_site", F.lit("new")))).where("score < 0.9").count() > 0


@pytest.mark.parametrize("name", ["random_forest", "linear_svc", "linear_regression"])
def test_kept_model_scores_alike(spark, tmp_out, name):
    df = planted(spark, n=600)
    e = models.fit_encoding(df, one_hot=name == "linear_svc")
    kept = models.Kept(name, models.fit(name, e.vectors(df, name in models.TREE_MODELS), e.arities), e)
    kept.save(f"{tmp_out}/kept")
    loaded = models.load_kept(spark, f"{tmp_out}/kept")
    key = lambda k: {r["dataset_name"]: r["score"] for r in k.score(df).collect()}
    assert loaded.name == name and key(loaded) == key(kept)


def test_choice_by_held_out_area(spark):
    best, areas = models.choose(planted(spark, n=1500), ["logistic_regression", "decision_tree"])
    got = {r["model"]: r["area_under_roc"] for r in areas.collect()}
    assert best.name == "decision_tree" and got["decision_tree"] > got["logistic_regression"] > 0.5
    assert best.score(planted(spark, n=50)).count() == 50


def test_sweep_encodes_once(spark):
    """Each label has the rows, and the area, that a study of that label alone has."""
    df = planted(spark, n=1200).drop("label").selectExpr("*", "dataset_size * 2 as readbytes", "1.0d as numaccesses", "1.0d as proctime")
    got = {(r["metric"], r["threshold"]): r for r in models.sweep(df, [("readbytes", 100.0), ("dataset_size", 80.0), ("numaccesses", 50.0)], "decision_tree").collect()}
    assert len(got) == 3 and got["numaccesses", 50.0]["area_under_roc"] is None and got["numaccesses", 50.0]["n_positive"] == 0
    from hotsets.operators import features
    for (metric, threshold), r in got.items():
        train, test = sampling.train_test_split(sampling.balanced_sample(features.with_label(df, metric, threshold)))
        assert (r["n_train"], r["n_held_out"], r["n_positive"]) == (train.count(), test.count(), test.where("label = 1").count())
    alone = evaluate.areas(evaluate.curve(models.train_and_score("decision_tree", *sampling.train_test_split(sampling.balanced_sample(
        features.with_label(df, "readbytes", 100.0))), vocab_rows=df))).first()["area_under_roc"]
    assert abs(got["readbytes", 100.0]["area_under_roc"] - alone) < 1e-9


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("many", ["sweep", "choose"])
def test_passes_read_sampled_rows(spark, monkeypatch, many):
    """What is fitted and scored was sampled and written before: no pass over it hashes a key, and the
    features still say which of them are categories."""
    seen, fit, predict = [], models.fit, models.predict
    monkeypatch.setattr(models, "fit", lambda name, train, arities: seen.append(train) or fit(name, train, arities))
    monkeypatch.setattr(models, "predict", lambda model, df, *keep: seen.append(df) or predict(model, df, *keep))
    df = planted(spark, n=900)
    if many == "sweep":
        rows = df.drop("label").selectExpr("*", "dataset_size * 2 as readbytes", "1.0d as numaccesses", "1.0d as proctime")
        assert models.sweep(rows, [("readbytes", 100.0)], "decision_tree").first()["area_under_roc"] is not None
    else:
        models.choose(df, ["decision_tree"])
    assert len(seen) == 2 and all(s.count() > 0 for s in seen)
    for s in seen:
        assert "md5" not in _plan(s)
        nominal = s.schema["features"].metadata["ml_attr"]["attrs"]["nominal"]
        assert {a["name"]: a["num_vals"] for a in nominal}["f_server_site"] == 5


def test_score_twice_moves_no_row(spark):
    """Both scores of each row, without an exchange of the rows."""
    df = planted(spark, n=600)
    e = models.fit_encoding(df)
    train = e.vectors(df).select("label", "features").localCheckpoint()
    deep, flat = models.Kept("decision_tree", models.fit("decision_tree", train, e.arities), e), models.Kept("random_forest", models.fit("random_forest", train, e.arities), e)
    rows = verify.with_row_number(df)
    both = models.score_twice(deep, flat, rows)
    assert "hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    got = {r["_row"]: (r["again"], r["score"]) for r in both.collect()}
    want = {r["_row"]: r["score"] for r in deep.score(rows, "_row").collect()}, {r["_row"]: r["score"] for r in flat.score(rows, "_row").collect()}
    assert got == {k: (want[0][k], want[1][k]) for k in want[0]} and len(got) == 600
    agree = {k for k, (a, b) in got.items() if abs(a - b) <= 1e-9}
    assert 0 < len(agree) < 600 or not agree
    assert verify.agreeing(both).count() == len(agree)
    assert verify.agreeing(models.score_twice(deep, deep, rows)).count() == 600


def test_tree_rows_are_dealt_by_their_number(spark, monkeypatch):
    """A tree learner's partitions grow in number, not in rows; few rows stay as they lie."""
    seen = {}

    class Learner:
        def fit(self, train):
            seen["rows"] = [len(p) for p in train.select("label").rdd.glom().collect()]

    monkeypatch.setattr(models, "estimator", lambda name, bins: Learner())
    df = spark.range(0, 4000, numPartitions=2).selectExpr("cast(id % 2 as double) as label")
    models.fit("decision_tree", df, {"f_week": 53})
    assert seen["rows"] == [2000, 2000]
    monkeypatch.setattr(models, "ROWS_PER_TASK", 20)
    models.fit("random_forest", df, {"f_week": 53})
    assert len(seen["rows"]) == 200 and sum(seen["rows"]) == 4000 and max(seen["rows"]) <= 30


def test_score_twice_looks_each_value_up_once(spark):
    """Each model's ids are those of its own vocabulary, and the code generated for both scores can be compiled."""
    import re
    df = planted(spark, n=600)
    # two vocabularies, each with values that the other does not have
    old, new = (models.fit_encoding(df.where(w)) for w in ("server_site <> 'S0'", "server_site <> 'S3' and client_domain = 'c2'"))
    assert old.sizes != new.sizes
    first, second = (models.Kept("random_forest", models.fit("random_forest", e.vectors(df).select("label", "features").localCheckpoint(), e.arities), e) for e in (old, new))
    both = models.score_twice(first, second, verify.with_row_number(df))
    want = [{r["dataset_name"]: r["score"] for r in k.score(df).collect()} for k in (first, second)]
    assert {r["dataset_name"]: (r["again"], r["score"]) for r in both.collect()} == {k: (want[0][k], want[1][k]) for k in want[0]}
    assert _plan(both).count("Join LeftOuter") == 9
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = spark._jvm.PythonSQLUtils.explainString(verify.agreeing(both).select("label")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the JVM leaves methods of over 8000 bytes uncompiled
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < 8000


def test_tree_rows_are_dealt_once(spark, monkeypatch):
    """However often a learner reads rows that were dealt anew, they are dealt out once; nothing is kept after it."""
    passes = spark.sparkContext.accumulator(0)
    seen = {}

    def counted(rows):
        for row in rows:
            passes.add(1)
            yield row

    class Learner:
        def fit(self, train):
            seen["train"] = train
            for _ in range(3):
                assert train.select("label").rdd.count() == 4000

    monkeypatch.setattr(models, "estimator", lambda name, bins: Learner())
    monkeypatch.setattr(models, "ROWS_PER_TASK", 20)
    df = spark.createDataFrame(spark.range(0, 4000, numPartitions=2).selectExpr("cast(id % 2 as double) as label").rdd.mapPartitions(counted), "label double")
    models.fit("decision_tree", df, {"f_week": 53})
    # counting them and dealing them out
    assert passes.value == 8000
    assert not seen["train"].is_cached and not seen["train"].storageLevel.useDisk

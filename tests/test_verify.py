"""The checks of fitted models pass for the fit and fail for a score that is not one."""

import pytest
from pyspark.sql import functions as F

from hotsets.ml import models, verify
from tests.test_models import planted


@pytest.fixture(scope="module")
def rows(spark):
    return planted(spark, n=1500)


def fitted(name, rows):
    model, train, _ = models.train(name, rows, rows)
    return model, verify.with_row_number(models.predict(model, train, "features"))


def constant(scored):
    mean = scored.agg(F.avg("label")).first()[0]
    return scored.withColumn("score", F.lit(mean))


@pytest.mark.parametrize("name", models.MODEL_NAMES)
def test_exported_model_gives_the_scores(spark, rows, name):
    model, _, score = models.train(name, rows, rows)
    score = verify.with_row_number(score)
    scored = models.predict(model, score, "_row")
    again = verify.score_again(model, score)
    assert verify.agreeing(scored, again).count() == 1500
    # not those of another score
    assert verify.agreeing(scored.withColumn("score", F.lit(0.25)), again).count() < 300


@pytest.mark.parametrize("name", ["linear_regression", "logistic_regression"])
def test_moments_turn_red_for_a_constant(spark, rows, name):
    _, scored = fitted(name, rows)

    def both(df):
        truth = {r["feature"]: r["moment"] for r in verify.moments(df.withColumn("score", F.col("label"))).collect()}
        got = {r["feature"]: r["moment"] for r in verify.moments(df).collect()}
        return {f for f in truth if abs(truth[f] - got[f]) > 1e-6}

    assert both(scored) == set()
    # a constant has the mean right and the weighted means wrong
    assert "intercept" not in both(constant(scored)) and {"dataset_size", "f_server_site"} & both(constant(scored))


def test_hinge_subgradient_turns_red_for_a_constant(spark, rows):
    _, scored = fitted("linear_svc", rows)
    red = [r["feature"] for r in verify.hinge_subgradient(scored, tolerance=0.05).collect() if not r["optimal"]]
    assert red == []
    for value in (0.0, -0.5):
        red = [r["feature"] for r in verify.hinge_subgradient(scored.withColumn("score", F.lit(value)), tolerance=0.05).collect() if not r["optimal"]]
        assert "dataset_size" in red and "intercept" in red


def test_boosted_leaf_means_turn_red_for_other_labels(spark, rows):
    model, scored = fitted("gbt", rows)
    r = verify.boosted_leaf_means(model, scored).first()
    assert (r["n_rows"], r["n_wrong"], r["better"]) == (1500, 0, True)
    other = verify.boosted_leaf_means(model, scored.withColumn("label", 1 - F.col("label"))).first()
    assert other["n_wrong"] > 0 and not other["better"]


def test_forest_checks_turn_red_for_a_constant(spark, rows):
    model, scored = fitted("random_forest", rows)
    r = verify.forest_checks(model, scored).first()
    assert r["better"] and r["n_wrong"] == 0 and r["n_rows"] == 1500
    assert not verify.forest_checks(model, constant(scored)).first()["better"]


def test_rows_reach_their_leaves_without_a_join_per_level(spark, rows):
    """One join, with the leaves; a wide categorical split, a threshold and a leaf high up are all walked."""
    nodes = spark.createDataFrame([
        (0, 0, 0.0, [4.0, 4.0], 1, 4, 0, [0.0, 900.0], 1000), (0, 1, 0.0, [2.0, 2.0], 2, 3, 1, [0.5], -1), (0, 2, 1.0, [2.0, 0.0], -1, -1, -1, [], -1),
        (0, 3, 0.0, [0.0, 2.0], -1, -1, -1, [], -1), (0, 4, 1.0, [2.0, 2.0], -1, -1, -1, [], -1), (1, 0, 1.0, [4.0, 4.0], -1, -1, -1, [], -1)],
        "tree int, id int, prediction double, stats array<double>, left int, right int, feature int, values array<double>, categories int")
    from pyspark.ml.functions import array_to_vector
    df = spark.createDataFrame([(0, [0.0, 0.5]), (1, [900.0, 0.6]), (2, [899.0, 0.1]), (3, [901.0, 9.0]), (4, [0.0, -3e12])], "_row long, x array<double>").select("_row", array_to_vector("x").alias("features"))
    found = verify.leaves(df, nodes, 2, 5)
    assert sorted((r["_row"], r["tree"], r["id"]) for r in found.collect()) == sorted([(i, 1, 0) for i in range(5)] + [(0, 0, 2), (1, 0, 3), (2, 0, 4), (3, 0, 4), (4, 0, 2)])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    only_leaf = verify.leaves(df, nodes.where("tree = 1").selectExpr("0 as tree", *nodes.columns[1:]), 1, 0)
    assert [r["id"] for r in only_leaf.collect()] == [0] * 5

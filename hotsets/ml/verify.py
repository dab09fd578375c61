"""Checks of fitted models against the rows they were fitted to.

A model is read back from what it exports (coefficients, or the node table that it saves) and
evaluated with DataFrame functions: ``score_again``.  What fitting promises is checked on the
training rows: moments of a least-squares or logistic fit, the hinge subgradient of a linear SVM, the
leaf means of boosted trees, the node counts of a forest.  Each is one aggregate over the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from hotsets.operators.features import FEATURE_ORDER
from hotsets.sources.handoff import hand_off, owner_of


#: a fit must leave less than this share of the best constant's loss
BETTER = 0.999


def with_row_number(df: DataFrame) -> DataFrame:
    """``df`` written once, each row with a number (``_row``) to find it by."""
    return hand_off(df.withColumn("_row", F.monotonically_increasing_id()))


# ---- trees -----------------------------------------------------------------------

def node_table(model, df: DataFrame) -> DataFrame:
    """One row per node of a tree model, as saved: ``tree``, ``id``, ``prediction``, ``stats``, ``left``, ``right``
    (-1 for a leaf), ``feature``, ``values`` (left categories, or the threshold), ``categories`` (-1: a threshold)."""
    spark = df.sparkSession
    path = owner_of(spark).new_path()
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        nodes = nodes.withColumn("tree", F.lit(0))
    return nodes.select("tree", "id", "prediction", F.col("impurityStats").alias("stats"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("values"),
                        F.col("split.numCategories").alias("categories"))


def leaves(df: DataFrame, nodes: DataFrame, n_trees: int, depth: int) -> DataFrame:
    """The leaf that each row (``_row``, ``features``) reaches in each tree: ``_row``, ``tree``, ``id``, ``prediction``, ``stats``.

    The inner nodes (model-sized) go to every task, where all rows of a batch go down a level at a
    time; a row passes its task once and is not copied for each tree and level.
    """
    walk = _walk(nodes, n_trees, depth)
    at = df.select("_row", F.posexplode(walk(vector_to_array("features"))).alias("tree", "id"))
    return at.join(F.broadcast(nodes.select("tree", "id", "prediction", "stats")), ["tree", "id"])


def _walk(nodes: DataFrame, n_trees: int, depth: int):
    """A function of the feature array: the id of the leaf in each tree."""
    inner = nodes.where("left >= 0").select("tree", "id", "left", "right", "feature", "categories", "values").toArrow().combine_chunks()
    number = {c: inner[c].to_numpy().astype(np.int64) for c in ("tree", "id", "left", "right", "feature", "categories")}
    size = 1 + max([0, *(int(number[c].max()) for c in ("id", "left", "right") if inner.num_rows)])
    at = number["tree"] * size + number["id"]
    # by node: children, feature and threshold; a leaf is its own child
    left, right = np.tile(np.arange(size), n_trees), np.tile(np.arange(size), n_trees)
    left[at], right[at] = number["left"], number["right"]
    feature, threshold, by_category = np.zeros(n_trees * size, np.int64), np.zeros(n_trees * size), np.zeros(n_trees * size, bool)
    feature[at], by_category[at] = number["feature"], number["categories"] >= 0
    # left categories as sorted numbers (node, category), so memory is that of the saved nodes
    lists = [np.asarray(v, float) for v in inner["values"].to_pylist()]
    wide = 1 + max(number["categories"], default=0)
    wide = max(int(wide), 1)
    for n, v in zip(at, lists):
        if not by_category[n]:
            threshold[n] = v[0]
    members = np.sort(np.concatenate([np.zeros(0, np.int64), *[n * wide + v.astype(np.int64) for n, v in zip(at, lists) if by_category[n]]]))

    @F.pandas_udf("array<int>")
    def walk(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
        each, found = np.arange(len(rows)), np.zeros((len(rows), n_trees), np.int32)
        for tree in range(n_trees):
            here = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = tree * size + here
                value = rows[each, feature[node]]
                key = node * wide + value.astype(np.int64)
                place = np.searchsorted(members, key)
                member = members[np.minimum(place, len(members) - 1)] == key if len(members) else np.zeros(len(rows), bool)
                goes_left = np.where(by_category[node], member, value <= threshold[node])
                here = np.where(goes_left, left[node], right[node])
            found[:, tree] = here
        return pd.Series(list(found))

    return walk


def _trees(model) -> tuple[int, int, list[float]]:
    """Number of trees, greatest depth, weights."""
    trees = getattr(model, "trees", [model])
    return len(trees), max(t.depth for t in trees), list(getattr(model, "treeWeights", [1.0]))


def _is_boosted(model) -> bool:
    return "GBT" in type(model).__name__


def _weighted(weights: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("tree") + 1)


# ---- scores ----------------------------------------------------------------------

def score_again(model, df: DataFrame) -> DataFrame:
    """``_row``, ``again``: the score of every row, from the exported model."""
    if hasattr(model, "coefficients"):
        products = F.zip_with(vector_to_array("features"), F.array(*[F.lit(float(c)) for c in model.coefficients]), lambda x, c: x * c)
        margin = F.aggregate(products, F.lit(float(model.intercept)), lambda a, p: a + p)
        if "LogisticRegression" in type(model).__name__:
            margin = 1 / (1 + F.exp(-margin))
        return df.select("_row", margin.alias("again"))
    n, depth, weights = _trees(model)
    found = leaves(df, node_table(model, df), n, depth)
    if _is_boosted(model):
        margin = found.groupBy("_row").agg(F.sum(_weighted(weights) * F.col("prediction")).alias("m"))
        return margin.select("_row", (1 / (1 + F.exp(-2 * F.col("m")))).alias("again"))
    share = F.get("stats", F.lit(1)) / F.aggregate("stats", F.lit(0.0), lambda a, s: a + s)
    return found.groupBy("_row").agg(F.avg(share).alias("again"))


def agreeing(scored: DataFrame, again: DataFrame | None = None, tolerance: float = 1e-9) -> DataFrame:
    """The scored rows whose score the exported model gives too: ``again``, in a table by ``_row`` or,
    without one, beside the score."""
    near = F.abs(F.col("score") - F.col("again")) <= tolerance * F.greatest(F.lit(1.0), F.abs("again"))
    both = scored if again is None else scored.join(again, "_row")
    return both.where(near).drop("again")


# ---- fits ------------------------------------------------------------------------

def moments(scored: DataFrame, names: list[str] = FEATURE_ORDER, tolerance: float = 1e-4) -> DataFrame:
    """``feature``, ``n_rows``, ``moment``: the mean label weighted by each (non-negative) feature, and by 1.

    A least-squares or logistic fit with an intercept leaves the same mean for its scores (the
    gradient is zero).  Where the scores' mean is farther off than ``tolerance`` it is given
    instead of the labels'.  ``scored``: ``label``, ``score``, ``features`` of the training rows.
    """
    x = scored.select("label", "score", vector_to_array("features").alias("x"))
    weights = {"intercept": F.lit(1.0), **{name: F.get("x", F.lit(i)) for i, name in enumerate(names)}}
    sums = [F.count(F.lit(1)).alias("n")]
    for k, w in enumerate(weights.values()):
        sums += [F.sum(w).alias(f"w{k}"), F.sum(w * F.col("label")).alias(f"y{k}"), F.sum(w * F.col("score")).alias(f"p{k}")]
    rows = [F.struct(F.lit(name).alias("feature"), F.col(f"w{k}").alias("w"), F.col(f"y{k}").alias("y"), F.col(f"p{k}").alias("p")) for k, name in enumerate(weights)]
    long = x.agg(*sums).select("n", F.explode(F.array(*rows)).alias("r")).select("n", "r.*")
    y, p = (F.when(F.col("w") > 0, F.col(c) / F.col("w")).otherwise(0.0) for c in ("y", "p"))
    return long.select("feature", F.col("n").alias("n_rows"), F.when(F.abs(y - p) <= tolerance, y).otherwise(p).alias("moment"))


def category_moments(scored: DataFrame, columns: list[str], tolerance: float = 0.02) -> DataFrame:
    """``feature``, ``value``, ``n_rows``, ``label_mean``: the mean label of the rows of each category.

    A one-hot fit leaves the same mean for its scores in every category; where theirs is farther off
    than ``tolerance`` it is given instead.  ``scored``: ``label``, ``score`` and the category columns.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = scored.selectExpr("label", "score", f"stack({len(columns)}, {pairs}) AS (feature, value)")
    means = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("label").alias("y"), F.avg("score").alias("p"))
    return means.select("feature", "value", "n_rows", F.when(F.abs(F.col("y") - F.col("p")) <= tolerance, F.col("y")).otherwise(F.col("p")).alias("label_mean"))


def hinge_subgradient(scored: DataFrame, names: list[str] = FEATURE_ORDER, kink: float = 1e-2, tolerance: float = 1e-2) -> DataFrame:
    """``feature``, ``n_rows``, ``label_share``, ``optimal``: whether 0 is a subgradient of the hinge loss in each feature.

    Rows inside the margin pull with y x; rows whose margin is 1 to within ``kink`` may pull
    with any part of it.  Features are scaled by their standard deviation, as the fit scales
    them; ``tolerance`` is what 50 iterations leave of the pull, in scaled units a row.
    """
    x = scored.select("label", "score", vector_to_array("features").alias("x"))
    y = 2 * F.col("label") - 1
    gap = 1 - y * F.col("score")
    weights = {"intercept": F.lit(1.0), **{name: F.get("x", F.lit(i)) for i, name in enumerate(names)}}
    sums = [F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")]
    for k, w in enumerate(weights.values()):
        sums += [F.stddev(w).alias(f"s{k}"), F.sum(F.when(gap > kink, y * w).otherwise(0.0)).alias(f"g{k}"),
                 F.sum(F.when(F.abs(gap) <= kink, F.abs(w)).otherwise(0.0)).alias(f"e{k}")]
    rows = [F.struct(F.lit(name).alias("feature"), F.lit(1.0).alias("s") if k == 0 else F.col(f"s{k}").alias("s"), F.col(f"g{k}").alias("g"), F.col(f"e{k}").alias("e"))
            for k, name in enumerate(weights)]
    long = x.agg(*sums).select("n", "share", F.explode(F.array(*rows)).alias("r")).select("n", "share", "r.*")
    rest = (F.abs("g") - F.col("e")) / F.col("n")
    return long.select("feature", F.col("n").alias("n_rows"), F.col("share").alias("label_share"),
                       F.coalesce(F.when(F.col("s") > 0, rest <= F.lit(tolerance) * F.col("s")), F.lit(True)).alias("optimal"))


def boosted_leaf_means(model, train: DataFrame) -> DataFrame:
    """``n_rows``, ``n_wrong``, ``better``: each boosted tree's leaf holds the mean of what was left to explain.

    The first tree explains the label (-1 or 1), the next ones 4 y / (1 + exp(2 y F)) for the weighted
    sum F of the trees before.  ``n_wrong`` counts leaves for which that does not hold,
    ``better``: the fit's log loss is below that of a constant.  ``train``: ``_row``, ``label``, ``features``.
    """
    n, depth, weights = _trees(model)
    found = leaves(train, node_table(model, train), n, depth).join(train.select("_row", "label"), "_row")
    step = _weighted(weights) * F.col("prediction")
    before = F.coalesce(F.sum(step).over(Window.partitionBy("_row").orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    y = 2 * F.col("label") - 1
    found = hand_off(found.select("_row", "tree", "id", "prediction", "label", step.alias("step"), y.alias("y"), before.alias("f")))
    left = F.when(F.col("tree") == 0, F.col("y")).otherwise(4 * F.col("y") / (1 + F.exp(2 * F.col("y") * F.col("f"))))
    wrong = (found.groupBy("tree", "id").agg(F.avg(left).alias("mean"), F.first("prediction").alias("prediction"))
             .agg(F.count_if(F.abs(F.col("mean") - F.col("prediction")) > 1e-9).alias("n_wrong")))
    total = found.groupBy("_row").agg(F.first("y").alias("y"), F.first("label").alias("label"), F.sum("step").alias("f"))
    share = F.avg("label")
    loss = total.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.log1p(F.exp(-2 * F.col("y") * F.col("f")))).alias("loss"), share.alias("share"))
    constant = -F.col("share") * F.log("share") - (1 - F.col("share")) * F.log1p(-F.col("share"))
    return loss.select("n_rows", (F.col("loss") < BETTER * constant).alias("better"), wrong.scalar().alias("n_wrong"))


def forest_checks(model, scored: DataFrame) -> DataFrame:
    """``n_rows``, ``constant_error``, ``better``, ``n_wrong``: the scores' mean squared error is below that of the best
    constant (``constant_error``), and no inner node's class counts differ from those of its children together."""
    nodes = node_table(model, scored)
    kids = nodes.select("tree", F.col("id").alias("kid"), F.col("stats").alias("kid_stats"))
    inner = nodes.where("left >= 0").select("tree", "id", "stats", F.explode(F.array("left", "right")).alias("kid")).join(kids, ["tree", "kid"])
    sums = inner.groupBy("tree", "id").agg(F.first("stats").alias("stats"), F.sum(F.get("kid_stats", F.lit(0))).alias("a"), F.sum(F.get("kid_stats", F.lit(1))).alias("b"))
    wrong = sums.agg(F.count_if((F.get("stats", F.lit(0)) != F.col("a")) | (F.get("stats", F.lit(1)) != F.col("b"))).alias("n_wrong"))
    d = F.col("score") - F.col("label")
    one = scored.agg(F.count(F.lit(1)).alias("n_rows"), F.var_pop("label").alias("constant_error"), F.avg(d * d).alias("error"))
    return one.select("n_rows", "constant_error", (F.col("error") < BETTER * F.col("constant_error")).alias("better"), wrong.scalar().alias("n_wrong"))

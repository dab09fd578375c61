"""The six estimators, feature assembly with categorical metadata, scoring.

Categorical ids are tagged as nominal attributes (``num_vals`` = arity) on
their columns; ``VectorAssembler`` carries the tags into the feature
vector, which is how Spark's tree learners receive the categorical
feature map.  The bin count is raised to the largest arity, because a
tree learner rejects a categorical feature with more values than bins.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import (DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassificationModel,
                                       GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression,
                                       LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from hotsets.operators import evaluate, features, sampling
from hotsets.schemas import METRICS, POPULARITY_KEYS
from hotsets.sources.handoff import hand_off

# fixed values: model settings
NUM_CLASSES = 2
IMPURITY = "gini"
MAX_DEPTH = 9
MAX_BINS = 8000
NUM_TREES = 10
FEATURE_SUBSET = "auto"
GBT_ITERATIONS = 10
GBT_DEPTH = 5
LINEAR_ITERATIONS = 50
SEED = 42
# memory for split statistics per pass: more nodes are split per pass
# over the data (fewer passes); the trees themselves do not change
TREE_MEMORY_MB = 1024
# depth-9 trees keep each row's node id between levels instead of walking
# the tree again (ids are checkpointed every 10 iterations); same trees
CACHE_NODE_IDS = True
# a tree learner keeps its rows in memory as objects, some 500 bytes a row and partition by partition,
# while files of short encoded rows are read into a partition for each core, however many rows there are
ROWS_PER_TASK = 500_000

MODEL_NAMES = ["decision_tree", "random_forest", "gbt", "linear_svc", "logistic_regression",
               "linear_regression"]
TREE_MODELS = ("decision_tree", "random_forest", "gbt")
# short model tags used in output folder names
MODEL_TAGS = {"decision_tree": "DT", "random_forest": "RF", "gbt": "GBT", "linear_svc": "SVM",
              "logistic_regression": "LogR", "linear_regression": "LR"}


def category_arities(vocab: DataFrame, unseen_bucket: bool = True,
                     sizes: dict[str, int] | None = None) -> dict[str, int]:
    """Arity per encoded column (one row per feature comes to the driver)."""
    extra = 1 if unseen_bucket else 0
    sizes = features.vocabulary_sizes(vocab) if sizes is None else sizes
    return {"f_week": features.WEEK_ARITY, **{f"f_{f}": n + extra for f, n in sizes.items()}}


def assemble(encoded: DataFrame, arities: dict[str, int], categorical: bool = True,
             output: str = "features", one_hot: bool = False) -> DataFrame:
    """label + the 11 feature columns -> ``features`` vector.

    ``one_hot``: a sparse vector with a slot for each category of each feature (in the order of
    the features and of their ids, the unseen bucket last), then the data-set size: a linear model
    has a coefficient per category then, instead of one for the id as a number.  The sizes come
    from the arities, so no pass over the rows is needed.
    """
    df = encoded
    if categorical or one_hot:
        for c, k in arities.items():
            meta = {"ml_attr": {"type": "nominal", "num_vals": int(k), "name": c}}
            df = df.withColumn(c, F.col(c).cast("double").alias(c, metadata=meta))
    inputs = list(features.FEATURE_ORDER)
    if one_hot:
        slots = {c: f"_slots_{c}" for c in inputs if c in arities}
        encoder = OneHotEncoder(inputCols=list(slots), outputCols=list(slots.values()), dropLast=False)
        df, inputs = encoder.fit(df).transform(df), [slots.get(c, c) for c in inputs]
    out = VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error").transform(df)
    return out.drop(*[c for c in inputs if c.startswith("_slots_")])


def category_coefficients(model, arities: dict[str, int], vocab: DataFrame) -> DataFrame:
    """``feature``, ``value``, ``unseen``, ``coefficient`` of a linear model over one-hot features.

    The coefficients are on the driver as part of the model; the values are joined to them.
    """
    at, rows, coefficients = 0, [], model.coefficients.toArray()
    for c in features.FEATURE_ORDER:
        n = arities.get(c, 1)
        rows += [(c.removeprefix("f_") if c in arities else c, i, i == n - 1 and c in arities and c != "f_week", float(x)) for i, x in enumerate(coefficients[at:at + n])]
        at += n
    slots = vocab.sparkSession.createDataFrame(rows, "feature string, idx long, unseen boolean, coefficient double")
    return slots.join(vocab.select("feature", "idx", "value"), ["feature", "idx"], "left").select("feature", "idx", "value", "unseen", "coefficient")


def estimator(name: str, max_bins: int = MAX_BINS):
    if name == "decision_tree":
        return DecisionTreeClassifier(impurity=IMPURITY, maxDepth=MAX_DEPTH, maxBins=max_bins, seed=SEED,
                                      maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=CACHE_NODE_IDS)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=NUM_TREES, featureSubsetStrategy=FEATURE_SUBSET,
                                      impurity=IMPURITY, maxDepth=MAX_DEPTH, maxBins=max_bins, seed=SEED,
                                      maxMemoryInMB=TREE_MEMORY_MB, cacheNodeIds=CACHE_NODE_IDS)
    if name == "gbt":
        return GBTClassifier(maxIter=GBT_ITERATIONS, maxDepth=GBT_DEPTH, maxBins=max_bins,
                             lossType="logistic", seed=SEED, maxMemoryInMB=TREE_MEMORY_MB)
    if name == "linear_svc":
        return LinearSVC(maxIter=LINEAR_ITERATIONS)
    if name == "logistic_regression":
        return LogisticRegression(family="binomial")
    if name == "linear_regression":
        return LinearRegression(maxIter=LINEAR_ITERATIONS)
    raise ValueError(f"unknown model {name!r}; one of {MODEL_NAMES}")


def fit(name: str, train: DataFrame, arities: dict[str, int]):
    """Fit one estimator on assembled training rows.  Trees get the
    categorical metadata; linear models see the raw ids as numbers.

    A tree learner uses no more bins than there are training rows, so a
    feature of more values cannot be split: that is said here, by name."""
    bins = max([MAX_BINS] + list(arities.values()))
    if name in TREE_MODELS:
        widest = max(arities, key=arities.get)
        rows = train.count()
        if arities[widest] > rows:
            raise ValueError(f"feature {widest} has {arities[widest]} categories but there are only {rows} training rows; "
                             f"set top_n (below {rows}) to keep its most frequent values and share one id among the rest")
        given, train = train, dealt(train, rows)
        if train is not given:
            # the learner reads its rows several times, and each time would deal them out anew
            train.persist(StorageLevel.DISK_ONLY)
            try:
                return estimator(name, bins).fit(train)
            finally:
                train.unpersist()
    return estimator(name, bins).fit(train)


def dealt(train: DataFrame, rows: int) -> DataFrame:
    """Training rows in at most ``ROWS_PER_TASK`` a partition; as they lie if the cores have no more than that each."""
    parts = -(-rows // ROWS_PER_TASK)
    return train.repartition(parts) if parts > train.sparkSession.sparkContext.defaultParallelism else train


def predict(model, df: DataFrame, *keep: str) -> DataFrame:
    """Row keys (and the held-out mark, as far as ``df`` has them), the columns to ``keep``, label, prediction, score: score =
    P(class 1) for probabilistic classifiers, the margin for the SVM, the
    regression output otherwise."""
    out = model.transform(df)
    cols = out.columns
    if "probability" in cols:
        score = vector_to_array("probability")[1]
    elif "rawPrediction" in cols:
        score = vector_to_array("rawPrediction")[1]
    else:
        score = F.col("prediction")
    keys = [c for c in [*POPULARITY_KEYS, "_held_out"] if c in cols]
    return out.select(*keys, *keep, F.col("label").cast("double").alias("label"),
                      F.col("prediction").cast("double").alias("prediction"),
                      score.cast("double").alias("score"))


@dataclass(frozen=True)
class Encoding:
    """A vocabulary and what follows from it: how rows become feature vectors."""

    vocab: DataFrame
    sizes: dict[str, int]
    one_hot: bool = False

    @property
    def arities(self) -> dict[str, int]:
        return category_arities(self.vocab, unseen_bucket=True, sizes=self.sizes)

    def vectors(self, rows: DataFrame, categorical: bool = True, unseen: str = "keep") -> DataFrame:
        return self.assembled(features.encode(features.with_week_feature(rows), self.vocab, unseen=unseen, sizes=self.sizes), categorical)

    def assembled(self, encoded: DataFrame, categorical: bool = True) -> DataFrame:
        return assemble(encoded, self.arities, categorical, one_hot=self.one_hot)


def fit_encoding(rows: DataFrame, top_n: int | None = None, one_hot: bool = False) -> Encoding:
    vocab = features.fit_vocabulary(rows, features.FEATURE_CATEGORIES, top_n)
    return Encoding(vocab, features.vocabulary_sizes(vocab), one_hot)


def prepare(train_rows: DataFrame, score_rows: DataFrame, categorical: bool = True,
            top_n: int | None = None, vocab_rows: DataFrame | None = None, one_hot: bool = False):
    """Vocabulary from ``vocab_rows`` (the whole training year, before
    balancing and splitting; default: the training rows); encode both sides
    (unseen values of the scored rows go to their own bucket); assemble
    vectors.  With ``top_n`` only the most frequent values of each feature
    get their own id and the rest share the extra bucket too."""
    e = fit_encoding(train_rows if vocab_rows is None else vocab_rows, top_n, one_hot)
    return e.vectors(train_rows, categorical, "error" if top_n is None else "keep"), e.vectors(score_rows, categorical), e.arities


def train(name: str, train_rows: DataFrame, score_rows: DataFrame, top_n: int | None = None, vocab_rows: DataFrame | None = None, one_hot: bool = False):
    """The fitted model, the training rows (label, features) and the rows to score, with their features.

    Training rows are written to the shared folder before fitting: the learners make many passes,
    and a lost executor must not send each pass back to the raw tables.
    """
    tr, sc, arities = prepare(train_rows, score_rows, categorical=name in TREE_MODELS, top_n=top_n, vocab_rows=vocab_rows, one_hot=one_hot)
    tr = hand_off(tr.select("label", "features"))
    return fit(name, tr, arities), tr, sc


def train_and_score(name: str, train_rows: DataFrame, score_rows: DataFrame,
                    top_n: int | None = None, vocab_rows: DataFrame | None = None, one_hot: bool = False) -> DataFrame:
    """Train ``name`` on ``train_rows`` and return predictions for ``score_rows``."""
    model, _, sc = train(name, train_rows, score_rows, top_n, vocab_rows, one_hot)
    return predict(model, sc)


def sweep(rows: DataFrame, labels: list[tuple[str, float]], name: str = "random_forest", top_n: int | None = None) -> DataFrame:
    """One model for each (metric, threshold) label: ``metric``, ``threshold``, ``n_train``, ``n_held_out``,
    ``n_positive`` (of those held out), ``area_under_roc`` (NULL if either part has one class only).

    Neither the features nor the numbers that rows are sampled by depend on the label, so the rows are
    encoded, hashed and written once; each label then balances, splits and fits on that table.  Its
    training rows are written too, for the learner's passes.
    """
    e = fit_encoding(rows, top_n)
    table = hand_off(sampling.with_draws(e.vectors(rows, name in TREE_MODELS)).select(*sampling.DRAWS, *METRICS, "features"))
    out = []
    for metric, threshold in labels:
        sample = sampling.balanced_sample(features.with_label(table, metric, threshold), drawn="_balance")
        parts = sampling.with_split(sample, drawn="_split").select("split", "label", "features")
        train, held = F.col("split") == "train", F.col("split") == "test"
        positive = F.col("label") == 1
        n = parts.agg(F.count_if(train).alias("n_train"), F.count_if(held).alias("n_held_out"), F.count_if(held & positive).alias("n_positive"),
                      F.count_if(train & positive).alias("n_train_positive")).first()
        area = None
        if 0 < n["n_positive"] < n["n_held_out"] and 0 < n["n_train_positive"] < n["n_train"]:
            model = fit(name, hand_off(parts.where(train).select("label", "features")), e.arities)
            area = evaluate.areas(evaluate.curve(predict(model, parts.where(held)))).first()["area_under_roc"]
        out.append((metric, float(threshold), n["n_train"], n["n_held_out"], n["n_positive"], area))
    return rows.sparkSession.createDataFrame(out, "metric string, threshold double, n_train long, n_held_out long, n_positive long, area_under_roc double")


# ---- models that are kept ----------------------------------------------------------

_CLASSES = {"decision_tree": DecisionTreeClassificationModel, "random_forest": RandomForestClassificationModel, "gbt": GBTClassificationModel,
            "linear_svc": LinearSVCModel, "logistic_regression": LogisticRegressionModel, "linear_regression": LinearRegressionModel}


@dataclass(frozen=True)
class Kept:
    """A fitted model with the encoding it was fitted with."""

    name: str
    model: object
    encoding: Encoding

    def score(self, rows: DataFrame, *keep: str) -> DataFrame:
        """Predictions for rows of the weekly table (with ``label``), without any training."""
        return predict(self.model, self.encoding.vectors(rows, self.name in TREE_MODELS), *keep)

    def save(self, path: str) -> None:
        """Model and vocabulary under one folder; a later job loads them with ``load_kept``."""
        spark = self.encoding.vocab.sparkSession
        self.model.write().save(f"{path}/model")
        self.encoding.vocab.write.parquet(f"{path}/vocabulary")
        spark.createDataFrame([(self.name, self.encoding.one_hot)], "name string, one_hot boolean").write.parquet(f"{path}/about")


def load_kept(spark: SparkSession, path: str) -> Kept:
    about = spark.read.parquet(f"{path}/about").first()
    vocab = spark.read.parquet(f"{path}/vocabulary")
    return Kept(about["name"], _CLASSES[about["name"]].load(f"{path}/model"), Encoding(vocab, features.vocabulary_sizes(vocab), about["one_hot"]))


def score_twice(first: Kept, second: Kept, rows: DataFrame) -> DataFrame:
    """``second``'s predictions, each with ``first``'s score of the same row (``again``).

    A row passes both models where it lies, so the scores need not be brought together by a join; it is
    encoded by both vocabularies at once."""
    row = [c for c in ["_row"] if c in rows.columns]
    seconds = [f"g_{c}" for c in features.FEATURE_CATEGORIES]
    encoded = features.encode_twice(features.with_week_feature(rows), first.encoding.vocab, second.encoding.vocab, (first.encoding.sizes, second.encoding.sizes))
    again = predict(first.model, first.encoding.assembled(encoded, first.name in TREE_MODELS), *row, "f_week", *seconds, "dataset_size")
    again = again.withColumnsRenamed({"score": "again", **{c: f"f_{c[2:]}" for c in seconds}}).drop("prediction")
    return predict(second.model, second.encoding.assembled(again, second.name in TREE_MODELS), *row, "again")


def choose(rows: DataFrame, names: list[str] = MODEL_NAMES, top_n: int | None = None) -> tuple[Kept, DataFrame]:
    """The best of several models by the area under the ROC curve on held-out rows, and all areas
    (``model``, ``n_rows``, ``n_positive``, ``n_scores``, ``area_under_roc``).

    The rows are encoded, split and written once, each part in a folder of its own; every model is fitted
    to the training part and scores the held-out part.  Equal areas: the first named.
    """
    e = fit_encoding(rows, top_n)
    table = hand_off(sampling.with_split(e.vectors(rows)).select("split", "label", "features"), ["split"])
    fit_rows, held_out = (table.where(F.col("split") == part).drop("split") for part in ("train", "test"))
    found, areas = {}, []
    for name in names:
        found[name] = fit(name, fit_rows, e.arities)
        curve = hand_off(evaluate.curve(predict(found[name], held_out)))
        sizes = curve.agg(F.max(F.col("tp") + F.col("fp")).alias("n_rows"), F.max("tp").alias("n_positive"), F.count(F.lit(1)).alias("n_scores"))
        areas.append(evaluate.areas(curve).select(F.lit(name).alias("model"), *[sizes.select(c).scalar().alias(c) for c in sizes.columns], "area_under_roc"))
    table = hand_off(reduce(DataFrame.unionByName, areas))
    area = {r["model"]: r["area_under_roc"] for r in table.collect()}
    best = max(names, key=lambda n: area[n])
    return Kept(best, found[best], e), table

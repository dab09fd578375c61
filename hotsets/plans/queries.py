"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the whole test tables of ``sf_dir`` through the domain
adapters; none runs on fixed or made-up input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hotsets.functions.naming import dataset_parts, with_dataset_parts
from hotsets.functions.timefn import week_of_day_string, week_of_epoch_s
from hotsets.ml import models, verify
from hotsets.operators import evaluate, features, profile, replicas, sampling
from hotsets.operators.weekly import access_popularity, popularity_union
from hotsets.plans.domain import Domain
from hotsets.plans.output import rounded
from hotsets.plans.params import BUCKETS, HELD_OUT_SITE, LABEL_METRIC, LABEL_THRESHOLD, SWEEP, TRAIN_LAST_WEEK
from hotsets.schemas import DATASET_PART_COLUMNS, METRICS, POPULARITY, POPULARITY_COLUMNS, POPULARITY_KEYS, ddl
from hotsets.sources.buckets import buckets_for, co_located, write_bucketed
from hotsets.sources.handoff import beside, hand_off, owner_of
from hotsets.sources.readers import CORRUPT, observed_json, to_number, typed_numbers
from hotsets.sources.sinks import load_weeks

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---- sources, cleaning, weekly tables ---------------------------------------

@register("dataset_parts")
def q_dataset_parts(spark, sf_dir):
    cat = Domain(spark, sf_dir).file_catalog
    return cat.select("file_lfn", "dataset_name", *[c.alias(n) for n, c in dataset_parts("dataset_name").items()])


@register("access_clean")
def q_access_clean(spark, sf_dir):
    return rounded(Domain(spark, sf_dir).access_clean)


@register("popularity_weekly")
def q_popularity_weekly(spark, sf_dir):
    return rounded(Domain(spark, sf_dir).popularity)


@register("week_of_day_text")
def q_week_of_day_text(spark, sf_dir):
    """Accesses by the week of their day text (``yyyy/MM/dd``), and how many that week differs from the instant's."""
    clean = Domain(spark, sf_dir).access_clean
    differs = F.col("week") != week_of_epoch_s("cts")
    return clean.withColumn("week", week_of_day_string("TDay")).groupBy("week").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(differs).alias("n_other"))


@register("popularity_weekly_file_once")
def q_popularity_weekly_file_once(spark, sf_dir):
    """Variant of the weekly table where a file's size counts once per
    weekly group, not once per access."""
    d = Domain(spark, sf_dir)
    return rounded(access_popularity(d.access_clean, d.file_catalog, file_size_once=True))


@register("popularity_weekly_bucketed")
def q_popularity_weekly_bucketed(spark, sf_dir):
    """The weekly table from accesses and catalog that are stored in buckets of the file key."""
    d, tag = Domain(spark, sf_dir), uuid.uuid4().hex
    buckets = buckets_for(d.access_clean.count(), BUCKETS)
    accesses = write_bucketed(d.access_clean, f"accesses_{tag}", "file_lfn", buckets)
    catalog = write_bucketed(d.file_catalog, f"catalog_{tag}", "file_lfn", buckets)
    return rounded(access_popularity(*co_located(accesses, catalog)))


@register("popularity_weekly_loads")
def q_popularity_weekly_loads(spark, sf_dir):
    """The weekly table by year, put together from overlapping loads, as a repeated weekly job leaves it."""
    d, path = Domain(spark, sf_dir), owner_of(spark).new_path()
    weekly = hand_off(access_popularity(d.access_clean, d.file_catalog, by_year=True))
    for load in ("week <= 30", "week > 20", "week between 25 and 35"):
        load_weeks(weekly.where(load), path)
    return rounded(spark.read.schema(weekly.schema).parquet(path).select(weekly.columns))


@register("jobs_weekly")
def q_jobs_weekly(spark, sf_dir):
    return rounded(Domain(spark, sf_dir).jobs_popularity)


@register("popularity_union")
def q_popularity_union(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return rounded(popularity_union(d.popularity, d.jobs_popularity))


@register("typed_rows")
def q_typed_rows(spark, sf_dir):
    """Popularity rows written as comma text lines, parsed back with the
    16-field schema (the text-file reader of the training job)."""
    pop = Domain(spark, sf_dir).popularity
    # to_csv quotes fields that contain the separator; NULL becomes an
    # empty field, which from_csv reads back as NULL
    line = F.to_csv(F.struct(*[F.col(c) for c in POPULARITY_COLUMNS]))
    parsed = pop.select(F.from_csv(line, ddl(POPULARITY), {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rounded(parsed)


@register("json_corrupt_filter")
def q_json_corrupt_filter(spark, sf_dir):
    """Lines read as text fields, as the JSON reader does: only a malformed
    line is corrupt, and a number may have any JSON form."""
    lines = Domain(spark, sf_dir).access_json_lines
    parsed = lines.select("event_id", F.from_json(
        "line", "k string, other string, _corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("j"))
    return parsed.filter(F.col("j._corrupt_record").isNull()).select("event_id", to_number(F.col("j.k"), LongType()).alias("k"))


@register("json_observed_counts")
def q_json_observed_counts(spark, sf_dir):
    """Rows, malformed lines and unreadable numbers, counted by the job that writes the readable lines."""
    schema = StructType([StructField("k", LongType()), StructField("other", LongType()), StructField(CORRUPT, StringType())])
    text = Domain(beside(spark), sf_dir).access_json_lines.select(F.from_json("line", ", ".join(f"{f.name} string" for f in schema.fields), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j")).select("j.*")
    found, kept = Observation("lines"), Observation("kept")
    clean = typed_numbers(observed_json(text, schema, found), schema).where(F.col(CORRUPT).isNull())
    hand_off(clean.select("k").observe(kept, F.count(F.lit(1)).alias("n")))
    counts = {**found.get, "rows kept": kept.get["n"]}
    return spark.createDataFrame(sorted(counts.items()), "name string, n_rows long")


@register("analyses_distinct")
def q_analyses_distinct(spark, sf_dir):
    return profile.conference_groups(Domain(spark, sf_dir).analyses)


@register("analyses_filter")
def q_analyses_filter(spark, sf_dir):
    return profile.analyses_of_conference(Domain(spark, sf_dir).analyses, "en")


@register("src_count")
def q_src_count(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return profile.table_counts({
        "access_raw": d.access_raw, "access_clean": d.access_clean,
        "file_catalog": d.file_catalog, "dataset_catalog": d.dataset_catalog,
        "replica_snapshots": d.replica_snapshots, "jobs": d.jobs, "analyses": d.analyses,
    })


# ---- replicas ----------------------------------------------------------------

@register("replica_bytes")
def q_replica_bytes(spark, sf_dir):
    return rounded(replicas.replica_bytes(Domain(spark, sf_dir).replica_snapshots))


@register("block_bytes")
def q_block_bytes(spark, sf_dir):
    return rounded(replicas.block_bytes(Domain(spark, sf_dir).replica_snapshots))


@register("replica_factor")
def q_replica_factor(spark, sf_dir):
    return replicas.replication_factor(Domain(spark, sf_dir).replica_snapshots)


@register("replica_factor_per_snapshot")
def q_replica_factor_per_snapshot(spark, sf_dir):
    return replicas.replication_factor(Domain(spark, sf_dir).replica_snapshots, per_snapshot=True)


@register("replica_histogram")
def q_replica_histogram(spark, sf_dir):
    rf = replicas.replication_factor(Domain(spark, sf_dir).replica_snapshots)
    return profile.ordered_histogram(profile.log_histogram(rf, "replicas"), "replicas")


@register("sql_view")
def q_sql_view(spark, sf_dir):
    """Replication factor as one SQL text over the snapshot table, then
    ``SELECT *`` of it.  The table is passed as an argument, so no view stays
    behind in the session."""
    return spark.sql("""
        WITH block AS (
          SELECT dataset_name, block_id, block_bytes, bool_or(readable) AS readable,
                 sum(br_node_bytes) FILTER (WHERE readable) AS held
          FROM (SELECT *, coalesce(NOT (node_name LIKE ANY ('%MSS', '%Buffer', '%Export')), false) AS readable FROM {snapshots})
          GROUP BY dataset_name, block_id, block_bytes),
        factor AS (
          SELECT floor(try_divide(sum(held), sum(block_bytes))) AS replicas, dataset_name
          FROM block GROUP BY dataset_name HAVING bool_or(readable))
        SELECT * FROM factor WHERE replicas > 1""", snapshots=Domain(spark, sf_dir).replica_snapshots)


# ---- profiles over the weekly table -----------------------------------------

def _metric_histogram(metric: str) -> Query:
    def q(spark, sf_dir):
        return profile.log_histogram(Domain(spark, sf_dir).popularity, metric)
    q.__name__ = f"q_metric_histogram_{metric}"
    return q


for _m in METRICS:
    register(f"metric_histogram_{_m}")(_metric_histogram(_m))


@register("metric_histograms")
def q_metric_histograms(spark, sf_dir):
    """All four histograms from one pass."""
    return profile.log_histograms(Domain(spark, sf_dir).popularity, METRICS)


@register("user_access_counts")
def q_user_access_counts(spark, sf_dir):
    return profile.user_access_counts(Domain(spark, sf_dir).popularity)


@register("user_histogram")
def q_user_histogram(spark, sf_dir):
    return profile.user_histogram(Domain(spark, sf_dir).popularity)


@register("top_datasets")
def q_top_datasets(spark, sf_dir):
    return rounded(profile.top_datasets(Domain(spark, sf_dir).popularity, n=10))


# ---- features, sampling -------------------------------------------------------




def popularity_table(spark, sf_dir) -> DataFrame:
    """The weekly access table as written (doubles to 2 places)."""
    return rounded(Domain(spark, sf_dir).popularity)


def labelled(spark, sf_dir) -> DataFrame:
    return features.with_label(popularity_table(spark, sf_dir), LABEL_METRIC, LABEL_THRESHOLD)


def labelled_table(spark, sf_dir) -> DataFrame:
    """The labelled weekly table written once for jobs that read it several
    times (vocabulary, encoding, training, scoring), as the weekly table is
    written once and read by the training job.  Files are as many as the
    tasks that made it; a filter on ``week`` is pushed to their row groups.
    Metrics that are no features are left out once the label is known, and the parts
    of the dataset name are not written: they follow from the name where it is read."""
    table = _features_only(labelled(spark, sf_dir))
    return with_dataset_parts(hand_off(table.drop(*DATASET_PART_COLUMNS))).select(table.columns)


def _features_only(lab: DataFrame) -> DataFrame:
    return lab.drop(*[m for m in METRICS if m != "dataset_size"])


@register("vocabulary")
def q_vocabulary(spark, sf_dir):
    return features.vocabulary(popularity_table(spark, sf_dir))


def _vocab_query(col: str) -> Query:
    def q(spark, sf_dir):
        v = features.vocabulary(popularity_table(spark, sf_dir), [col])
        return v.select("value", "idx")
    q.__name__ = f"q_vocab_{col}"
    return q


for _c in features.VOCAB_COLUMNS:
    register(f"vocab_{_c}")(_vocab_query(_c))


@register("vocabulary_versions")
def q_vocabulary_versions(spark, sf_dir):
    """A vocabulary of the training weeks (without one site), then what the later weeks add to it, then
    the same weeks again, which add nothing."""
    train, week = training_and_week(spark, sf_dir)
    first = hand_off(features.first_version(features.vocabulary(train.filter(~F.col("server_site").eqNullSafe(HELD_OUT_SITE)), features.FEATURE_CATEGORIES)))
    second = hand_off(first.unionByName(features.extend_vocabulary(first, week, 2)))
    return second.unionByName(features.extend_vocabulary(second, week, 3))


@register("label_popular")
def q_label_popular(spark, sf_dir):
    return labelled(spark, sf_dir).select(*POPULARITY_KEYS, LABEL_METRIC, "label")


@register("class_counts")
def q_class_counts(spark, sf_dir):
    return features.class_counts(labelled(spark, sf_dir))


def _features_out(df: DataFrame) -> DataFrame:
    return df.select("label", *features.FEATURE_ORDER)


@register("features_indexed")
def q_features_indexed(spark, sf_dir):
    lab = labelled_table(spark, sf_dir)
    vocab = features.fit_vocabulary(lab, features.FEATURE_CATEGORIES)
    enc = features.encode(features.with_week_feature(lab), vocab, unseen="error")
    return _features_out(enc)


def training_and_week(spark, sf_dir):
    """Training rows (weeks up to 40) and the rows of the later weeks to score."""
    lab = labelled_table(spark, sf_dir)
    return lab.filter(F.col("week") <= TRAIN_LAST_WEEK), lab.filter(F.col("week") > TRAIN_LAST_WEEK)


def _score_week_features(unseen: str) -> Query:
    def q(spark, sf_dir):
        train, week = training_and_week(spark, sf_dir)
        # one site is left out of the vocabulary, so that it is unseen here
        seen = train.filter(~F.col("server_site").eqNullSafe(HELD_OUT_SITE))
        vocab = features.fit_vocabulary(seen, features.FEATURE_CATEGORIES)
        return _features_out(features.encode(features.with_week_feature(week), vocab, unseen=unseen))
    return q


register("score_week_features")(_score_week_features("keep"))
register("score_week_features_zero")(_score_week_features("zero"))


@register("balanced_sample")
def q_balanced_sample(spark, sf_dir):
    return sampling.balanced_sample(labelled(spark, sf_dir)).select(*POPULARITY_KEYS, "label")


@register("train_test_split")
def q_train_test_split(spark, sf_dir):
    s = sampling.with_split(sampling.balanced_sample(labelled(spark, sf_dir)))
    return s.select(*POPULARITY_KEYS, "label", "split")


# ---- evaluation of a rule-made score -------------------------------------------

def rule_predictions(spark, sf_dir) -> DataFrame:
    """(label, score, prediction) with score = floor(100 * s / (s + 2000)) / 100
    of the dataset size s: a fixed scoring rule, so the evaluation queries
    can be checked by plain SQL."""
    lab = labelled(spark, sf_dir)
    s = F.col("dataset_size")
    score = F.floor(F.lit(100.0) * s / (s + F.lit(2000.0))) / F.lit(100.0)
    return lab.select("label", score.alias("score")).withColumn(
        "prediction", F.when(F.col("score") >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)))


RATIO_DIGITS = 9


def fine_rule_predictions(spark, sf_dir) -> DataFrame:
    """A finer rule, floor(1000 * t / (t + 1e7)) / 1000 of the processing
    time t: hundreds of distinct scores, so the 100-bin threshold
    down-sampling is exercised."""
    lab = labelled(spark, sf_dir)
    t = F.col("proctime")
    score = F.floor(F.lit(1000.0) * t / (t + F.lit(1e7))) / F.lit(1000.0)
    return lab.select("label", score.alias("score"))


@register("confusion")
def q_confusion(spark, sf_dir):
    return rounded(evaluate.confusion(rule_predictions(spark, sf_dir)), RATIO_DIGITS)


@register("confusion_rates")
def q_confusion_rates(spark, sf_dir):
    return rounded(evaluate.confusion_rates(evaluate.confusion(rule_predictions(spark, sf_dir))), RATIO_DIGITS)


@register("rmse")
def q_rmse(spark, sf_dir):
    return rounded(evaluate.rmse(rule_predictions(spark, sf_dir)), RATIO_DIGITS)


@register("curve")
def q_curve(spark, sf_dir):
    return rounded(evaluate.curve_points(evaluate.curve(rule_predictions(spark, sf_dir))), RATIO_DIGITS)


@register("auc")
def q_auc(spark, sf_dir):
    return rounded(evaluate.areas(evaluate.curve(rule_predictions(spark, sf_dir))), RATIO_DIGITS)


# ---- models (no SQL oracle: rows-only check) -----------------------------------



def _train_query(name: str) -> Query:
    def q(spark, sf_dir):
        year = labelled_table(spark, sf_dir)
        train, test = sampling.train_test_split(sampling.balanced_sample(year))
        return models.train_and_score(name, train, test, vocab_rows=year)
    q.__name__ = f"q_train_{name}"
    return q


for _name in models.MODEL_NAMES:
    register(f"train_{_name}")(_train_query(_name))


@register("score_week")
def q_score_week(spark, sf_dir):
    """Random forest trained on the earlier weeks (balanced, then the 70 %
    training split, as for the held-out evaluation), scoring the later ones."""
    train, week = training_and_week(spark, sf_dir)
    fit_rows, _held_out = sampling.train_test_split(sampling.balanced_sample(train))
    return models.train_and_score("random_forest", fit_rows, week, vocab_rows=train)


# What plain SQL can say of the models' results: which rows are scored, with
# which label, and that totals, leaves and gradients add up.

def _scored_rows(name: str, model_name: str, parts) -> None:
    """Rows whose score the exported model, evaluated by DataFrame functions, gives too."""
    def q(spark, sf_dir):
        train, score, vocab_rows = parts(spark, sf_dir)
        model, _, rows = models.train(model_name, train, score, vocab_rows=vocab_rows)
        rows = verify.with_row_number(rows)
        return verify.agreeing(models.predict(model, rows, "_row"), verify.score_again(model, rows)).select(*POPULARITY_KEYS, "label")
    q.__name__ = f"q_scored_rows_{name}"
    register(f"scored_rows_{name}")(q)


def _year_parts(spark, sf_dir):
    year = labelled_table(spark, sf_dir)
    train, test = sampling.train_test_split(sampling.balanced_sample(year))
    return train, test, year


def _week_parts(spark, sf_dir):
    train, week = training_and_week(spark, sf_dir)
    return sampling.train_test_split(sampling.balanced_sample(train))[0], week, train


for _name in models.MODEL_NAMES:
    _scored_rows(_name, _name, _year_parts)
_scored_rows("week", "random_forest", _week_parts)


def _fitted(name: str, spark, sf_dir):
    """A model and its training rows, scored by it."""
    train, _, year = _year_parts(spark, sf_dir)
    model, rows, _ = models.train(name, train, train, vocab_rows=year)
    return model, verify.with_row_number(models.predict(model, rows, "features"))


def _moments(name: str) -> None:
    def q(spark, sf_dir):
        return rounded(verify.moments(_fitted(name, spark, sf_dir)[1]), 6)
    q.__name__ = f"q_fit_{name}"
    register(f"fit_{name}")(q)


_moments("linear_regression")
_moments("logistic_regression")


@register("fit_logistic_regression_one_hot")
def q_fit_logistic_regression_one_hot(spark, sf_dir):
    """A coefficient per category: in every category the scores have the labels' mean."""
    train, _, year = _year_parts(spark, sf_dir)
    model, _, rows = models.train("logistic_regression", train, train, vocab_rows=year, one_hot=True)
    columns = ["week", *features.FEATURE_CATEGORIES]
    scored = models.predict(model, rows, *[c for c in columns if c not in POPULARITY_KEYS])
    return rounded(verify.category_moments(scored, columns), RATIO_DIGITS)


@register("model_choice")
def q_model_choice(spark, sf_dir):
    """All six models fitted to one encoded table: rows held out, how many are positive, and whether the
    model tells them apart at all (the test tables' features say next to nothing of the label)."""
    # only the sample is read again
    _, areas = models.choose(hand_off(_features_only(sampling.balanced_sample(labelled(spark, sf_dir)))))
    return areas.select("model", "n_rows", "n_positive", (F.col("n_scores") > 1).alias("varied"))


@register("label_sweep")
def q_label_sweep(spark, sf_dir):
    """Several labels on one encoded table: the rows each trains on and holds out, and whether it could be fitted."""
    # vocabulary and encoding both read the rows
    found = models.sweep(hand_off(popularity_table(spark, sf_dir)), SWEEP, "decision_tree")
    return found.select("metric", "threshold", "n_train", "n_held_out", "n_positive", F.col("area_under_roc").between(0, 1).alias("fitted"))


@register("score_week_kept")
def q_score_week_kept(spark, sf_dir):
    """The later weeks scored by a model and vocabulary that were saved and loaded again: rows whose score
    is that of the model still in memory."""
    train, week, year = _week_parts(spark, sf_dir)
    e = models.fit_encoding(year)
    fitted = models.fit("random_forest", hand_off(e.vectors(train).select("label", "features")), e.arities)
    kept, path = models.Kept("random_forest", fitted, e), owner_of(spark).new_path()
    kept.save(path)
    both = models.score_twice(models.load_kept(spark, path), kept, week)
    return verify.agreeing(both).select(*POPULARITY_KEYS, "label")


@register("fit_linear_svc")
def q_fit_linear_svc(spark, sf_dir):
    return rounded(verify.hinge_subgradient(_fitted("linear_svc", spark, sf_dir)[1]), RATIO_DIGITS)


@register("fit_random_forest")
def q_fit_random_forest(spark, sf_dir):
    return rounded(verify.forest_checks(*_fitted("random_forest", spark, sf_dir)), RATIO_DIGITS)


@register("fit_gbt")
def q_fit_gbt(spark, sf_dir):
    return verify.boosted_leaf_means(*_fitted("gbt", spark, sf_dir))


@register("tree_leaf_means")
def q_tree_leaf_means(spark, sf_dir):
    """A decision tree's score is the mean label of the training rows of its
    leaf: rows scored, and scores for which that does not hold."""
    year = labelled_table(spark, sf_dir)
    train, _test = sampling.train_test_split(sampling.balanced_sample(year))
    scored = models.train_and_score("decision_tree", train, train, vocab_rows=year)
    leaves = scored.groupBy("score").agg(F.avg("label").alias("mean"), F.count(F.lit(1)).alias("n"))
    return leaves.agg(F.sum("n").alias("n_rows"), F.count_if(F.abs(F.col("mean") - F.col("score")) > 1e-9).alias("n_wrong"))


@register("score_week_totals")
def q_score_week_totals(spark, sf_dir):
    """Rows, positives and negatives that the week's confusion counts add up to."""
    c = evaluate.confusion(q_score_week(spark, sf_dir))
    return c.select("n", (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"))


@register("score_week_evaluation")
def q_score_week_evaluation(spark, sf_dir):
    """Confusion counts, rates and areas of the weekly random-forest scores."""
    preds = hand_off(q_score_week(spark, sf_dir))
    return rounded(evaluate.metrics(preds, evaluate.curve(preds)), RATIO_DIGITS)



@register("curve_binned")
def q_curve_binned(spark, sf_dir):
    return rounded(evaluate.curve_points(evaluate.curve(fine_rule_predictions(spark, sf_dir), num_bins=100)), RATIO_DIGITS)


@register("auc_binned")
def q_auc_binned(spark, sf_dir):
    return rounded(evaluate.areas(evaluate.curve(fine_rule_predictions(spark, sf_dir), num_bins=100)),
                   RATIO_DIGITS)


@register("roc_points")
def q_roc_points(spark, sf_dir):
    return rounded(evaluate.roc_points(evaluate.curve(fine_rule_predictions(spark, sf_dir), num_bins=100)),
                   RATIO_DIGITS)


@register("pr_points")
def q_pr_points(spark, sf_dir):
    return rounded(evaluate.pr_points(evaluate.curve(fine_rule_predictions(spark, sf_dir), num_bins=100)),
                   RATIO_DIGITS)

"""Evaluation of binary predictions: confusion counts, rates, RMSE,
threshold curves (precision, recall, F-measure, ROC, PR) and areas.

Counts come from one aggregate pass.  Curves first reduce the predictions
to one row per distinct score (partial aggregation), optionally merge
consecutive scores into at most ``num_bins`` blocks, and take running sums
with a range-partitioned scan, so no step gathers the data in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotsets.functions.numeric import safe_ratio
from hotsets.operators.indexing import ordered_index, running_sum
from hotsets.sources.handoff import hand_off


def _pos(label: str):
    return F.col(label) > 0.5


def confusion(preds: DataFrame, label: str = "label", prediction: str = "prediction", *more) -> DataFrame:
    """n, wrong, wrong_ratio, tp, tn, fp, fn (and ``more`` aggregates) in one pass."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return preds.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y != p).alias("wrong"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        *more,
    ).withColumn("wrong_ratio", safe_ratio("wrong", "n"))


def confusion_rates(conf: DataFrame) -> DataFrame:
    """TPR, TNR, FPR, FNR, accuracy, precision, F1 from the counts
    (NULL instead of an error or NaN when a denominator is 0)."""
    tp, tn, fp, fn, n = (F.col(c) for c in ("tp", "tn", "fp", "fn", "n"))
    tpr = safe_ratio(tp, tp + fn)
    tnr = safe_ratio(tn, tn + fp)
    return conf.select(
        tpr.alias("tpr"), tnr.alias("tnr"), (F.lit(1.0) - tnr).alias("fpr"), (F.lit(1.0) - tpr).alias("fnr"),
        safe_ratio(tp + tn, n).alias("accuracy"), safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def squared_error(label: str = "label", prediction: str = "prediction"):
    d = F.col(prediction).cast("double") - F.col(label).cast("double")
    return F.sqrt(F.avg(d * d)).alias("rmse")


def rmse(preds: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return preds.agg(squared_error(label, prediction))


def score_counts(preds: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, pos, neg): one row per distinct score."""
    return preds.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(_pos(label)).alias("pos"), F.count_if(~_pos(label)).alias("neg"))


def binned_counts(counts: DataFrame, num_bins: int = 100, n_scores: int | None = None):
    """Merge consecutive scores (descending) into blocks of
    ``n_scores // num_bins`` scores when that is 2 or more; the block's
    threshold is its lowest score, the one at which its counts hold.  ``num_bins <= 0`` keeps every score.
    Returns (table, its row count)."""
    if n_scores is None:
        n_scores = counts.count()
    grouping = n_scores // num_bins if num_bins > 0 else 0
    if grouping < 2:
        return counts, n_scores
    ranked = ordered_index(counts, None, "threshold", "_rank", descending=True)
    out = (ranked.groupBy(F.floor(F.col("_rank") / grouping).alias("_blk"))
           .agg(F.min("threshold").alias("threshold"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
           .drop("_blk"))
    return out, -(-n_scores // grouping)


def fmeasure(p, r, beta: float):
    b2 = beta * beta
    return F.when(p + r == 0, F.lit(0.0)).otherwise(
        F.lit(1.0 + b2) * (p * r) / (F.lit(b2) * p + r))


def curve(preds: DataFrame, score: str = "score", label: str = "label", num_bins: int = 0,
          betas: tuple[float, ...] = (1.0, 0.5)) -> DataFrame:
    """Per threshold (descending): point index, tp, fp, precision, recall,
    fpr, f-measures; one row per distinct score, or per block of scores when
    ``num_bins`` asks for it.  ``prev_precision``, ``prev_recall`` and
    ``prev_fpr`` are those of the point before (NULL, 0 and 0 for the first):
    the running sum without the point's own counts."""
    # one pass over the predictions; everything after reads the per-score
    # table (distinct scores only)
    counts = hand_off(score_counts(preds, score, label))
    totals = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                        F.count(F.lit(1)).alias("S")).first()
    counts, n_points = binned_counts(counts, num_bins, int(totals["S"]))
    total_pos, total_neg = int(totals["P"] or 0), int(totals["N"] or 0)
    cum = running_sum(counts.withColumn("_one", F.lit(1)), "threshold", ["pos", "neg", "_one"],
                      descending=True, known_rows=n_points)
    def rates(tp, fp):
        return (F.when(tp + fp == 0, F.lit(1.0)).otherwise(tp / (tp + fp)),
                F.when(F.lit(total_pos) == 0, F.lit(0.0)).otherwise(tp / F.lit(float(max(total_pos, 1)))),
                F.when(F.lit(total_neg) == 0, F.lit(0.0)).otherwise(fp / F.lit(float(max(total_neg, 1)))))

    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    precision, recall, fpr = rates(tp, fp)
    before_precision, before_recall, before_fpr = rates(tp - F.col("pos"), fp - F.col("neg"))
    out = cum.select((F.col("cum__one") - 1).cast("long").alias("point"), "threshold",
                     tp.alias("tp"), fp.alias("fp"), precision.alias("precision"),
                     recall.alias("recall"), fpr.alias("fpr"),
                     F.when(F.col("cum__one") > 1, before_precision).alias("prev_precision"),
                     before_recall.alias("prev_recall"), before_fpr.alias("prev_fpr"))
    for b in betas:
        name = "f1" if b == 1.0 else "f" + str(b).replace(".", "_")
        out = out.withColumn(name, fmeasure(F.col("precision"), F.col("recall"), b))
    return out


def areas(crv: DataFrame) -> DataFrame:
    """Area under ROC (from (0,0)) and under PR (from (0, first precision))
    by trapezoids between each point and the one before it, which ``curve``
    gives with the point: one aggregate, no join and no second window."""
    roc = (F.col("fpr") - F.col("prev_fpr")) * (F.col("recall") + F.col("prev_recall")) / 2
    # the PR curve starts at (0, precision of the highest threshold)
    start = F.coalesce(F.col("prev_precision"), F.col("precision"))
    pr = (F.col("recall") - F.col("prev_recall")) * (F.col("precision") + start) / 2
    return crv.agg(F.sum(roc).alias("area_under_roc"), F.sum(pr).alias("area_under_pr"))


def curve_points(crv: DataFrame) -> DataFrame:
    """The curve without the helper columns of the point before."""
    return crv.drop("prev_precision", "prev_recall", "prev_fpr")


def roc_points(crv: DataFrame) -> DataFrame:
    """ROC curve (point, x = FPR, y = TPR): (0, 0), one point per
    threshold in descending order, then (1, 1)."""
    first = crv.agg(F.lit(0).cast("long").alias("point"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    mid = crv.select((F.col("point") + 1).alias("point"), F.col("fpr").alias("x"), F.col("recall").alias("y"))
    last = crv.agg(F.coalesce(F.max("point") + 2, F.lit(1)).cast("long").alias("point"),
                   F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    return first.unionByName(mid).unionByName(last)


def pr_points(crv: DataFrame) -> DataFrame:
    """Precision-recall curve (point, x = recall, y = precision): starts at
    (0, precision of the highest threshold), then one point per threshold."""
    first = crv.filter(F.col("point") == 0).select(
        F.lit(0).cast("long").alias("point"), F.lit(0.0).alias("x"), F.col("precision").alias("y"))
    mid = crv.select((F.col("point") + 1).alias("point"), F.col("recall").alias("x"),
                     F.col("precision").alias("y"))
    return first.unionByName(mid)


def _long(df: DataFrame) -> DataFrame:
    """A one-row table as (metric, value) rows (``stack``, no join)."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in df.columns)
    return df.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (metric, value)")


def metrics(preds: DataFrame, crv: DataFrame | None = None, label: str = "label",
            prediction: str = "prediction") -> DataFrame:
    """Every summary figure as (metric, value) rows: counts, wrong ratio,
    rates, F1 and RMSE from one aggregate pass over the predictions, plus
    the two areas when a curve is given."""
    one = confusion(preds, label, prediction, squared_error(label, prediction))
    wide = one.select("n", "wrong", "wrong_ratio", "tp", "tn", "fp", "fn", "rmse")
    rates = confusion_rates(one)
    out = _long(wide).unionByName(_long(rates))
    if crv is not None:
        out = out.unionByName(_long(areas(crv)))
    return out

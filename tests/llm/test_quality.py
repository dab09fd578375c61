import numpy as np
from pyspark.sql import functions as F

from hotsets.llm import quality
from tests.conftest import SF_MID
from tests.llm.cases import awkward, clashing, empty


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    y = np.array([r["quality"] for r in rows])
    s = np.array([r["score"] for r in rows])
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.97
    assert (s[y == 1] >= 0.7).mean() > 0.97 and (s[y == 0] < 0.7).mean() > 0.8


def test_fit_against_numpy(spark):
    rng = np.random.default_rng(1)
    d = len(quality.STATISTICS)
    x = rng.normal(size=(300, d)) @ rng.normal(size=(d, d))
    y = (rng.random(300) < 0.4).astype(int)
    x[y == 1] += 1
    stats = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, x array<double>").repartition(7)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(0, 1 - int(y[0])), (1, int(y[1])), (5, None), (999, 1)], "doc_id long, quality int")
    model = quality.fit(stats, labels)
    x, y = x[1:], y[1:]  # row 0 has contradicting labels
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    pooled = np.diag(np.diag((n[0] * cov[0] + n[1] * cov[1]) / n.sum()))
    logs = []
    for c in (0, 1):
        a = max(0.1, d / (d + n[c]))
        s = (1 - a) * cov[c] + a * pooled + 1e-3 * np.eye(d)
        z = x - x[y == c].mean(axis=0)
        logs.append(np.log(n[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    want = 1 / (1 + np.exp(logs[0] - logs[1]))
    assert np.allclose(model.scores(x), want, atol=1e-8)


def test_scores_do_not_read_other_columns_or_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet")
    a = quality.quality_scores(docs, labels)
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    b = quality.quality_scores(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), turned)
    both = a.join(b.withColumnRenamed("score", "other"), "doc_id")
    assert both.where(F.abs(F.col("score") - F.col("other")) > 1e-9).count() == 0


def test_awkward_rows_and_missing_labels(spark):
    df = clashing(awkward(spark))
    labels = spark.createDataFrame([(5, 1), (3, 0), (9, 1), (12, 0), (4, None)], "doc_id long, quality int")
    got = quality.quality_scores(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[0] == by[1] and len(by[5]) == 1
    ones = quality.quality_scores(df, labels.where("quality = 1")).collect()
    assert {round(r["score"], 6) for r in ones} == {1.0}
    none = quality.drop_low_quality(df, labels.limit(0))
    assert none.count() == df.count() and none.columns == df.columns
    assert quality.drop_low_quality(empty(spark), labels).count() == 0

import numpy as np
from pyspark.sql import functions as F

from hotsets.llm import toxicity
from hotsets.llm.quality import held_out
from tests.llm.cases import awkward, clashing, empty


def planted(spark, n=900, seed=4):
    rng = np.random.default_rng(seed)
    mild, words = [f"bad{i}" for i in range(6)], [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 60))
        y = int(rng.random() < 0.2)
        if y:
            for _ in range(rng.integers(1, 8)):
                text.insert(rng.integers(0, 60), str(rng.choice(mild)))
        rows.append((i, " ".join(text)))
        labels.append((i, y))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_recall_and_clean_documents(spark):
    docs, labels = planted(spark)
    rows = toxicity.toxicity_scores(docs, labels).join(labels.withColumnRenamed("toxic", "y"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    y, s = np.array([r["y"] for r in rows]), np.array([r["toxic"] for r in rows])
    assert (s[y == 1] >= 0.5).mean() > 0.95 and (s[y == 0] < 0.5).mean() > 0.99
    dense = np.array([r["dense"] for r in rows])
    assert dense[y == 1].mean() > dense[y == 0].mean() + 0.2


def test_chain_reads_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    first = (x[:, 0] > 0).astype(float)
    y = np.column_stack([first, first * (x[:, 1] > 0)])
    fold = np.arange(600) % 3
    chain = toxicity.fit_chain(x, y, fold)
    assert [len(w) for w in chain.weights] == [4, 5]  # the second model reads the first
    p = chain.probabilities(x)
    assert p.min() >= 0 and p.max() <= 1
    chained = ((p[:, 1] > 0.5) == (y[:, 1] > 0)).mean()
    w = toxicity.fit_linear((x - chain.centre) / chain.scale, y[:, 1])
    alone = ((((x - chain.centre) / chain.scale) @ w[:-1] + w[-1] > 0) == (y[:, 1] > 0)).mean()
    assert chained > 0.85 and chained >= alone
    # a row's label moves its own out-of-fold prediction only through the other folds
    turned = y.copy()
    turned[fold == 0, 0] = 1 - turned[fold == 0, 0]
    z = (x - chain.centre) / chain.scale
    a, b = (toxicity.fit_linear(z[fold != 0], t[fold != 0, 0]) for t in (y, turned))
    assert np.allclose(a, b)


def test_linear_fit_is_stationary():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + rng.normal(size=200) > 0).astype(float)
    w = toxicity.fit_linear(x, y)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert np.abs(x.T @ (y - p) - w[:-1]).max() < 1e-4 and abs((y - p).sum()) < 1e-3


def plain_chain(x, weights, centre, scale):
    """Scores of a chain, row by row."""
    out = []
    for row in x:
        z = [(a - c) / s for a, c, s in zip(row, centre, scale)]
        for w in weights:
            z.append(1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, w)) + w[-1]))))
        out.append(z[len(centre):])
    return np.array(out)


def test_scores_equal_the_plain_way(spark):
    """Markers, features, chain and scores of a small table, each worked out by loops."""
    docs, labels = planted(spark, 300)
    sample = toxicity.training_sample(docs, labels, "toxic", 20_000, "doc_id", "text").collect()
    markers = toxicity.learn_markers(spark.createDataFrame(sample))
    one, zero = [[r for r in sample if r["y"] == y] for y in (1, 0)]
    for m, odds in markers.items():
        a, b = (sum(any(m in toxicity.tokens_of(w.encode()) for w in r["text"].split()) for r in rows) for rows in (one, zero))
        assert abs(odds - (np.log((a + .5) / (len(one) - a + .5)) - np.log((b + .5) / (len(zero) - b + .5)))) < 1e-9
    names = list(markers)

    def features(text):
        seen = [sum(t == m for w in text.split() for t in toxicity.tokens_of(w.encode())) for m in names]
        n = len(text.split())
        return [*np.log1p(seen), sum(s * max(markers[m], 0) for s, m in zip(seen, names)) / (n + 20), sum(s > 0 for s in seen), sum(seen) / (n + 20), np.log1p(n)]

    x = np.array([features(r["text"]) for r in sample])
    y = np.array([float(r["y"]) for r in sample])
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)).alias("f")).collect()}
    target = np.column_stack([y * (x[:, -3] >= np.median(x[y == 1, -3])), y * (x[:, -2] >= np.median(x[y == 1, -2])), y])
    chain = toxicity.fit_chain(x, target, np.array([folds[r["doc_id"]] for r in sample]))
    rows = docs.collect()
    want = dict(zip([r["doc_id"] for r in rows], plain_chain([features(r["text"]) for r in rows], chain.weights, chain.centre, chain.scale)))
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == 300 and all(np.allclose([r[c] for c in toxicity.CHAIN], want[r["doc_id"]], atol=1e-6) for r in got)


def test_toxic_words_inside_text_without_blanks(spark):
    rng = np.random.default_rng(3)
    letters = [chr(0x4e00 + i) for i in range(400)]
    bad, rows, labels = "\u9f98\u9f99\u9f9a\u9f9b", [], []
    for i in range(300):
        text, y = "".join(rng.choice(letters, 120)), int(i % 4 == 0)
        rows.append((i, text[:50] + bad + text[50:] if y else text))
        labels.append((i, y))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity_scores(docs, marks).join(marks.withColumnRenamed("toxic", "y"), "doc_id").collect()
    assert all((r["toxic"] >= 0.5) == bool(r["y"]) for r in got)


def test_awkward_rows(spark):
    df = clashing(awkward(spark))
    labels = spark.createDataFrame([(3, 0), (4, 0), (5, 1), (7, None), (8, 1), (8, 0)], "doc_id long, toxic int")
    for marks in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = toxicity.toxicity_scores(df, marks)
        assert got.count() == df.count() and got.where("toxic < 0 or toxic > 1 or toxic is null").count() == 0
    assert toxicity.toxicity_scores(empty(spark), labels).count() == 0

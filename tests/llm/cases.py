"""Awkward documents shared by the tests of this folder."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
TEXTS = [
    None, "", " \t\n", "One", "one two", "Alpha beta gamma delta epsilon zeta eta theta iota kappa",
    "Alpha beta gamma delta epsilon zeta eta theta iota kappa", "É ÜBER 中文 ǅ k̊ İ K a", "x\ty\x0bz\x0c\r\n q", LONG, LONG + " end", "\n\n\n", "a" * 5000,
]


def awkward(spark):
    rows = [(i, t, "en", None if i % 2 else "s", None) for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "en", None, None), (None, "no id at all in this row", None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """Extra columns with names that the operators use themselves."""
    extra = ["fp", "key", "t", "h", "g", "n", "norm", "words", "score", "x", "y", "length", "start", "ids", "spans", "items", "component_id", "line_no",
             "a.b", "c`d"]
    return df.select("*", *[F.lit("extra").alias(c) for c in extra])


def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)

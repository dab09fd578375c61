"""Feature preparation: labels, vocabularies, encoding.

Vocabularies are DataFrames (feature, value, idx) built in one pass over
all categorical columns; ids follow the sorted value (stable between
runs).  Encoding joins each column to its vocabulary; Spark broadcasts the
ones that are small in bytes and shuffles the others.  NULL is a category
like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hotsets.operators.indexing import ordered_index
from hotsets.sources.handoff import hand_off

# fixed values: the categorical columns of the popularity table, in the
# feature order of the models (username is not a feature)
VOCAB_COLUMNS = ["dataset_name", "primary_dataset", "processed_dataset", "acquisition_era",
                 "processing_version", "datatier", "client_domain", "server_domain",
                 "server_site", "user_protocol"]
FEATURE_CATEGORIES = ["primary_dataset", "processed_dataset", "acquisition_era",
                      "processing_version", "datatier", "client_domain", "server_domain",
                      "server_site", "user_protocol"]
WEEK_ARITY = 53          # ids 0..52 for ISO weeks 1..53 (week - 1)
DEFAULT_LABEL_METRIC = "numaccesses"
DEFAULT_THRESHOLD = 50.0


def popular_label(metric: str = DEFAULT_LABEL_METRIC, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """1.0 when ``metric`` > ``threshold`` (strict), else 0.0."""
    return F.when(F.col(metric) > F.lit(threshold), F.lit(1.0)).otherwise(F.lit(0.0))


def with_label(df: DataFrame, metric: str = DEFAULT_LABEL_METRIC,
               threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return df.withColumn("label", popular_label(metric, threshold))


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))


def vocabulary(df: DataFrame, columns: list[str] = VOCAB_COLUMNS, top_n: int | None = None) -> DataFrame:
    """(feature, value, idx) for every column in one scan.

    The columns are unpivoted with ``stack`` (narrow), de-duplicated once
    (partial distinct on the map side), and numbered per feature by
    ``ordered_index`` (range partitioned, no single-task window).

    ``top_n`` keeps only the ``top_n`` most frequent values of each feature
    (ties by value); encoding with ``unseen='keep'`` then puts every other
    value into one shared bucket, which bounds a feature's arity (and the
    bins a tree learner needs) for very wide columns.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (feature, value)")
    if top_n is None:
        long = long.distinct()
    else:
        long = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    if top_n is not None:
        key = F.struct((-F.col("_n")).alias("n"), F.col("value").alias("v"))
        ranked = ordered_index(long.withColumn("_key", key), "feature", "_key", "_rank")
        long = ranked.filter(F.col("_rank") < top_n).select("feature", "value")
    # the range exchange reads the distinct pairs from their shuffle: the scan behind them runs once
    return ordered_index(long, "feature", "value", "idx")


def fit_vocabulary(df: DataFrame, columns: list[str] = VOCAB_COLUMNS, top_n: int | None = None) -> DataFrame:
    """Vocabulary written once, in the order of feature and value.

    Encoding reads it once per column, so it is computed a single time, its
    lineage is cut (a lost executor does not re-run the scan that produced it)
    and the planner knows its size.
    """
    return hand_off(vocabulary(df, columns, top_n))


FIRST_VERSION = 1


def first_version(vocab: DataFrame) -> DataFrame:
    """A vocabulary as version 1 of one that grows."""
    return vocab.withColumn("version", F.lit(FIRST_VERSION))


def extend_vocabulary(versioned: DataFrame, rows: DataFrame, version: int, columns: list[str] = FEATURE_CATEGORIES) -> DataFrame:
    """The next version: values of ``rows`` that no version has get the ids after each feature's last.

    Ids never move, so what was encoded or trained with an earlier version stays
    valid.  Only the distinct new values are ordered (by value).  Returns the rows to append:
    none if ``rows`` brings nothing new, so that a repeated load changes nothing.
    """
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in columns)
    seen = rows.selectExpr(f"stack({len(columns)}, {pairs}) AS (feature, value)").distinct().alias("s")
    known = versioned.select("feature", "value").alias("k")
    same = (F.col("s.feature") == F.col("k.feature")) & F.col("s.value").eqNullSafe(F.col("k.value"))
    fresh = ordered_index(seen.join(known, same, "left_anti"), "feature", "value", "idx")
    last = versioned.groupBy("feature").agg(F.max("idx").alias("last"))
    return fresh.join(last, "feature", "left").select("feature", "value", (F.col("idx") + F.coalesce(F.col("last") + 1, F.lit(0))).alias("idx"),
                                                      F.lit(version).alias("version"))


def at_version(versioned: DataFrame, version: int) -> DataFrame:
    """The vocabulary as it was at ``version``: what its models were trained with."""
    return versioned.where(F.col("version") <= version).select("feature", "value", "idx")


def arity(vocab: DataFrame) -> DataFrame:
    """(feature, size): vocabulary size per feature."""
    return vocab.groupBy("feature").agg(F.count(F.lit(1)).alias("size"))


def vocabulary_sizes(vocab: DataFrame) -> dict[str, int]:
    """{feature: number of values} (one small row per feature, one job)."""
    return {r["feature"]: int(r["size"]) for r in arity(vocab).collect()}


def encode(df: DataFrame, vocab: DataFrame, columns: list[str] = FEATURE_CATEGORIES,
           unseen: str = "error", sizes: dict[str, int] | None = None) -> DataFrame:
    """Add ``f_<column>`` ids for each categorical column.

    unseen='error' : inner meaning -- a value missing from the vocabulary
                     raises (checked with ``raise_error``, no row dropped).
    unseen='keep'  : unseen values get id = vocabulary size (own bucket).
    unseen='zero'  : unseen values get id 0 (shares the first category).
    ``sizes``: the vocabulary sizes when the caller already has them.
    """
    if unseen not in ("error", "keep", "zero"):
        raise ValueError(f"unseen must be error, keep or zero, not {unseen!r}")
    # vocabulary sizes: the id of the unseen bucket
    if sizes is None:
        sizes = vocabulary_sizes(vocab)
    out = df
    for c in columns:
        out = _looked_up(out, vocab, c, "idx")
        if unseen == "error":
            fid = F.col("_idx")
        elif unseen == "zero":
            fid = F.coalesce(F.col("_idx"), F.lit(0))
        else:
            fid = F.coalesce(F.col("_idx"), F.lit(sizes.get(c, 0)))
        out = out.withColumn(f"f_{c}", fid.cast("long")).drop("_idx")
    return _all_known(out, columns) if unseen == "error" and columns else out


def _looked_up(df: DataFrame, vocab: DataFrame, c: str, *ids: str) -> DataFrame:
    """Add ``_<id>`` for each of the vocabulary's id columns: NULL for a value that it does not have."""
    v = vocab.filter(F.col("feature") == c).select(F.col("value").alias("_v"), *[F.col(i).alias(f"_{i}") for i in ids])
    return df.join(v, F.col(c).cast("string").eqNullSafe(F.col("_v")), "left").drop("_v")


def encode_twice(df: DataFrame, first: DataFrame, second: DataFrame, sizes: tuple[dict[str, int], dict[str, int]],
                 columns: list[str] = FEATURE_CATEGORIES) -> DataFrame:
    """Add ``f_<column>``, the ids by the ``first`` vocabulary, and ``g_<column>``, those by the ``second``; each as
    ``encode`` gives them with unseen='keep'.

    The vocabularies are brought together first, so a row looks each value up once.  With a join for each column
    and vocabulary, the code that Spark generates for the chain of joins is too long to be compiled.
    """
    none = F.lit(None).cast("long")
    both = (first.select("feature", "value", F.col("idx").alias("f"), none.alias("g"))
            .unionByName(second.select("feature", "value", none.alias("f"), F.col("idx").alias("g"))))
    both = hand_off(both.groupBy("feature", "value").agg(F.max("f").alias("f"), F.max("g").alias("g")))
    out = df
    for c in columns:
        out = _looked_up(out, both, c, "f", "g")
        out = out.withColumns({f"{i}_{c}": F.coalesce(F.col(f"_{i}"), F.lit(n.get(c, 0))).cast("long") for i, n in zip("fg", sizes)}).drop("_f", "_g")
    return out


def _all_known(encoded: DataFrame, columns: list[str]) -> DataFrame:
    """``encoded``, which fails for a row with a value that has no id.

    One check after all joins: a message in each of them makes the code that Spark generates for
    the chain of joins too long to be compiled.
    """
    unknown = [F.when(F.col(f"f_{c}").isNull(), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))) for c in columns]
    text = F.array_join(F.filter(F.array(*unknown), lambda m: m.isNotNull()), ", ")
    any_unknown = reduce(lambda a, b: a | b, [F.col(f"f_{c}").isNull() for c in columns])
    checked = F.when(any_unknown, F.raise_error(F.concat(F.lit("value not in vocabulary of "), text)).cast("long"))
    return encoded.withColumns({f"f_{c}": F.coalesce(checked, F.col(f"f_{c}")) if c == columns[0] else F.col(f"f_{c}") for c in columns})


def with_week_feature(df: DataFrame) -> DataFrame:
    """Week as a 0-based category id (ISO weeks 1..53 -> 0..52)."""
    return df.withColumn("f_week", (F.col("week") - 1).cast("long"))


FEATURE_ORDER = ["f_week"] + [f"f_{c}" for c in FEATURE_CATEGORIES] + ["dataset_size"]

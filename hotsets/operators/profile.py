"""Distribution profiles: log-scale histograms, per-user counts, top-k,
table counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hotsets.functions.numeric import log_bucket


def log_histogram(df: DataFrame, metric: str, bucket_name: str | None = None) -> DataFrame:
    """(CEILING(LN(metric)), COUNT(*)) -- one shuffle of at most a few
    dozen partial rows per task (map-side combine)."""
    name = bucket_name or metric
    return (df.groupBy(log_bucket(metric).alias(name))
            .agg(F.count(F.lit(1)).alias("occurrences")))


def log_histograms(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, bucket, occurrences) of several metrics from one scan and one shuffle: each row
    gives a bucket per metric, combined before the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), log_bucket(m).alias("bucket")) for m in metrics]))
    return df.select(pairs.alias("p")).groupBy("p.metric", "p.bucket").agg(F.count(F.lit(1)).alias("occurrences"))


def ordered_histogram(hist: DataFrame, bucket_name: str) -> DataFrame:
    """Histogram sorted by occurrences (bucket as tie-break)."""
    return hist.orderBy(F.col("occurrences"), F.col(bucket_name).asc_nulls_first())


def user_access_counts(pop: DataFrame) -> DataFrame:
    """Rows per (dataset, user); named ``rows_per_user`` after the table it feeds."""
    return pop.groupBy("dataset_name", "username").agg(F.count(F.lit(1)).alias("rows_per_user"))


def user_histogram(pop: DataFrame) -> DataFrame:
    """Two-level aggregate: log histogram of the per-(dataset, user) counts."""
    return log_histogram(user_access_counts(pop), "rows_per_user")


def top_datasets(pop: DataFrame, n: int = 10, by: str = "numaccesses") -> DataFrame:
    """The ``n`` datasets with the most accesses (the limit is the report).

    ORDER BY + LIMIT plans as TakeOrderedAndProject: each task keeps its
    own top ``n`` and only those reach the final merge.
    """
    agg = pop.groupBy("dataset_name").agg(
        F.sum(by).alias(f"total_{by}"), F.sum("readbytes").alias("total_readbytes"),
        F.count(F.lit(1)).alias("n_rows"))
    return agg.orderBy(F.col(f"total_{by}").desc(), F.col("total_readbytes").desc(),
                       F.col("dataset_name").asc()).limit(n)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (table_name, n_rows) per table, all counts in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def analyses_of_conference(analyses: DataFrame, conference: str) -> DataFrame:
    """Analyses presented at one conference (a narrow filter)."""
    return analyses.filter(F.col("Conference") == F.lit(conference))


def conference_groups(analyses: DataFrame) -> DataFrame:
    """Distinct (conference, physics group, samples) triples."""
    return analyses.select(F.col("Conference").alias("conference"), "physWG", "samples").distinct()

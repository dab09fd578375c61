"""Writers.  The default save mode refuses to overwrite an existing path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DEFAULT_MODE = "errorifexists"


def write_csv(df: DataFrame, path: str, mode: str = DEFAULT_MODE, header: bool = False) -> None:
    """Headerless CSV (a CSV round trip turns '' and NULL both into NULL;
    keep parquet for internal hand-offs)."""
    df.write.mode(mode).option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = DEFAULT_MODE,
                  partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def popularity_output_dir(source: str, suffix: str = "week1") -> str:
    """Folder name of a weekly table, from its source name."""
    return f"weekly_{source.lower()}_{suffix}"


def predictions_output_dir(model: str, metric: str, threshold, suffix: str = "week1") -> str:
    return f"{model}_{metric}_{threshold}_{suffix}"


def write_popularity(df: DataFrame, path: str, fmt: str = "csv", mode: str = DEFAULT_MODE) -> None:
    """CSV as the training job reads it, or parquet partitioned by week
    (a later filter on ``week`` then reads only that folder)."""
    if fmt == "csv":
        write_csv(df, path, mode)
    else:
        write_parquet(df, path, mode, partition_by=["week"])


def load_weeks(pop: DataFrame, path: str) -> None:
    """Put the weeks of ``pop`` (with ``year`` and ``week``) into the Parquet table at ``path``.

    A load can be repeated: it replaces the weeks it holds, whole, and leaves all
    others untouched (dynamic partition overwrite).  New files appear only when the job
    commits, so one that fails changes nothing.  Rows are gathered by week for few files; a
    week that is too large for a task is split.
    """
    (pop.hint("rebalance", "year", "week").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "week").parquet(path))


def write_label_prediction(preds: DataFrame, path: str, mode: str = DEFAULT_MODE,
                           single_file: bool = False) -> None:
    """``label,prediction`` text lines.  ``single_file`` funnels the rows
    through one task; use it only for results known to be small."""
    lines = preds.select(F.concat_ws(",", F.col("label").cast("string"),
                                     F.col("prediction").cast("string")).alias("value"))
    if single_file:
        lines = lines.repartition(1)
    lines.write.mode(mode).text(path)


def write_curve(points: DataFrame, path: str, x: str, y: str, mode: str = DEFAULT_MODE) -> None:
    """Curve points as ``x,y`` text lines."""
    points.select(F.concat_ws(",", F.col(x).cast("string"), F.col(y).cast("string")).alias("value")) \
        .write.mode(mode).text(path)

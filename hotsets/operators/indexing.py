"""Consecutive ids by sort order, computed without a one-partition window.

``dense_rank() OVER (PARTITION BY g ORDER BY v)`` puts a whole group into
one task; a wide group (a dataset-name vocabulary, the distinct scores of
a curve) would then be sorted by a single core.  Here the rows are range
partitioned on (g, v) instead, numbered inside each range, and shifted by
the row counts of the earlier ranges of the same group.

The plan is the same at every size; the number of ranges follows the bytes
(``ordered_index``) or the row count (``running_sum``: about ``ROWS_PER_RANGE``
rows in a range), and no cluster setting deals a small table into thousands of
ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hotsets.sources.handoff import hand_off

ROWS_PER_RANGE = 250_000


def _ranges(df: DataFrame, num_partitions: int | None, known_rows: int | None) -> int:
    if num_partitions:
        return num_partitions
    rows = df.count() if known_rows is None else known_rows
    return max(1, -(-rows // ROWS_PER_RANGE))


def _tagged_ranges(df: DataFrame, n: int, *order) -> DataFrame:
    """Range partition ``df``, tag each row with its range and write the result.

    Range bounds come from a sample taken when the exchange runs; the rows
    are read twice below (numbering and counting), and two separate runs
    of the exchange could sample different bounds.  Writing them once fixes
    one assignment for both reads, also when an executor is lost.  Only
    distinct keys pass through here, not raw rows.
    """
    return hand_off(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))


def ordered_index(df: DataFrame, group_col: str | None, order_col: str, name: str = "idx",
                  descending: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 0-based position of each row within its group, in
    ascending (or descending) order of ``order_col``.  Rows should be
    distinct on (group_col, order_col); ties get consecutive ids in an
    unspecified order.  NULLs sort first ascending, last descending.

    One write: rows go into ranges of (group, order), are sorted there and
    written with a number that counts on within each range; Spark makes as many
    ranges as their bytes ask for (or ``num_partitions``).  What is left is
    the count of each group in each range, and one join with those.
    """
    gcols = [group_col] if group_col else []
    okey = F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_first()
    keys = [*[F.col(g).asc_nulls_first() for g in gcols], okey]
    dealt = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    # the upper bits of the number are the range, the lower ones count its rows
    placed = hand_off(dealt.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_pid", F.shiftright("_at", 33))
    counts = placed.groupBy(*gcols, "_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*gcols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*gcols, "_pid", "_first", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    # null-safe match on the group column (a NULL group is a real group)
    lo, of = placed.alias("_lo"), offsets.alias("_of")
    cond = [F.col("_lo._pid") == F.col("_of._pid")] + [
        F.col(f"_lo.{g}").eqNullSafe(F.col(f"_of.{g}")) for g in gcols]
    return lo.join(of, cond).select(
        *[F.col(f"_lo.`{c}`").alias(c) for c in df.columns],
        (F.col("_of._off") + F.col("_lo._at") - F.col("_of._first")).cast("long").alias(name))


def running_sum(df: DataFrame, order_col: str, value_cols: list[str], descending: bool = False,
                prefix: str = "cum_", num_partitions: int | None = None,
                known_rows: int | None = None) -> DataFrame:
    """Add ``cum_<c>`` = SUM(c) over all rows up to and including this one
    in ``order_col`` order (values of ``order_col`` should be distinct).

    Same range-partition pattern as ``ordered_index``: running sums inside
    each range, plus the totals of all earlier ranges (a table of at most
    ``num_partitions`` rows).  ``known_rows``: the row count, if the caller
    has taken it already.
    """
    okey = F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_first()
    n = _ranges(df, num_partitions, known_rows)
    ranged = _tagged_ranges(df, n, okey)
    w = Window.partitionBy("_pid").orderBy(okey).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({f"_l_{c}": F.sum(c).over(w) for c in value_cols})
    totals = local.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}")
                                      for c in value_cols])
    out = local.join(offsets, "_pid")
    return out.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{prefix}{c}")
                                     for c in value_cols])

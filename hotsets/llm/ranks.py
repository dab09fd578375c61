"""Positions of rows within groups, in order, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hotsets.llm.common import handoff

ROWS_PER_RANGE = 50_000


def ranked(df: DataFrame, group: list[str], order: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with ``pos`` (0-based, by ``order`` within ``group``, NULLs first), ``total`` (the group's
    rows) and ``first`` (the smallest value of the first order column in the group, NULLs apart).

    Rows are dealt into ranges of (group, order) and numbered inside each; a table of counts by
    range, not the rows, gives the offsets.  So a group may hold all rows, and equal rows may too:
    the place in the written table settles ties, and decides which range they go to.  Rows of
    NULL groups form a group.  The range of each row is written with it before it is read twice, so a
    lost executor cannot deal rows differently the second time.  Returns a written table.
    """
    src = handoff(df).withColumn("__tie", F.monotonically_increasing_id())
    ranges = max(1, -(-src.count() // rows_per_range))
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]] + [F.col("__tie")]
    dealt = handoff(src.repartitionByRange(ranges, *keys).withColumn("__range", F.spark_partition_id()))
    own = Window.partitionBy("__range", *group).orderBy(*keys[len(group):])
    rows = dealt.withColumn("__own", F.row_number().over(own) - 1)
    counts = dealt.groupBy("__range", *group).agg(F.count("*").alias("__n"), F.min(order[0]).alias("__first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__range", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("total"),
                            F.min("__first").over(whole).alias("first"))
    a, b = rows.alias("a"), offsets.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group], F.col("a.__range") == F.col("b.__range"))
    return handoff(a.join(b, same).select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("b.__before") + F.col("a.__own")).alias("pos"), F.col("b.total").alias("total"), F.col("b.first").alias("first")))

"""Hand-offs are dropped with their owner's work."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from hotsets.operators.features import vocabulary
from hotsets.sources import handoff
from tests.conftest import SF_SMALL


def mine(spark, name):
    return [t for t in handoff.left(spark) if t.startswith(name + "-")]


def test_tables_live_as_long_as_a_result_that_reads_them(spark):
    owned = handoff.own(spark, "living")
    result = handoff.hand_off(owned.range(10).withColumn("x", F.col("id") * 2)).where("x > 4")
    del owned
    handoff.sweep(spark, collect=True)
    assert len(mine(spark, "living")) == 1 and result.count() == 7
    further = result.select("x").distinct()  # what derives from a result keeps its tables too
    del result
    handoff.sweep(spark, collect=True)
    assert further.count() == 7
    del further
    handoff.sweep(spark, collect=True)
    assert mine(spark, "living") == []


def test_owner_drops_after_an_error_and_half_written(spark):
    with pytest.raises(Exception, match="no row"):
        with handoff.owning(spark, "failing") as owned:
            handoff.hand_off(owned.range(5))
            assert len(mine(spark, "failing")) == 1
            handoff.hand_off(owned.range(5).withColumn("x", F.when(F.col("id") == 3, F.raise_error(F.lit("no row"))).otherwise(F.lit("a"))))
    assert mine(spark, "failing") == []


def test_handle_is_the_same_session(spark):
    owned = handoff.own(spark, "same")
    owned.range(3).createOrReplaceTempView("seen_by_both")
    assert spark.table("seen_by_both").count() == 3
    assert owned.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    spark.catalog.dropTempView("seen_by_both")


@pytest.mark.parametrize("name", ["vocabulary", "features_indexed", "auc", "score_week_features"])
def test_queries_leave_nothing(spark, name):
    result = E.queries()[name](spark, SF_SMALL)
    assert mine(spark, name) != []
    assert result.where(F.lit(True)).count() > 0
    del result
    handoff.sweep(spark, collect=True)
    assert mine(spark, name) == []


def test_next_query_sweeps_the_last(spark):
    E.queries()["vocabulary"](spark, SF_SMALL).count()
    second = E.queries()["vocabulary"](spark, SF_SMALL)
    assert len(mine(spark, "vocabulary")) == len(handoff.owner_of(second.sparkSession).paths) > 0


def test_unowned_work_belongs_to_the_session(spark):
    before = mine(spark, "session")
    assert vocabulary(spark.range(4).select(F.col("id").alias("a")), ["a"]).count() == 4
    assert len(mine(spark, "session")) == len(before) + 1

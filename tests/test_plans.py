"""Plan properties that matter at scale (read from explain output)."""

import contextlib
import io
import re

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def _scan_section(text, table):
    m = re.search(r"Scan parquet[^\n]*\n(?:[^\n]+\n)*?Location: [^\n]*" + table + r"\.parquet[^\n]*\n"
                  r"(?:PushedFilters: ([^\n]*)\n)?ReadSchema: ([^\n]*)", text)
    assert m, f"no scan of {table}"
    return m.group(1) or "", m.group(2)


def test_flagship_pushes_filters_and_prunes_columns(spark):
    text = plan(E.queries()["popularity_weekly"](spark, SF_SMALL))
    pushed, schema = _scan_section(text, "lineitem")
    assert "GreaterThan(l_extendedprice,0.0)" in pushed
    for unused in ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus"):
        assert unused not in schema
    # partial aggregation on the map side, final after the shuffle
    assert "partial_sum" in text and "partial_count" in text


def test_replication_factor_scans_once(spark):
    for name in ("replica_factor", "replica_factor_per_snapshot", "replica_histogram", "sql_view"):
        text = plan(E.queries()[name](spark, SF_SMALL))
        scans = re.findall(r"Location: [^\n]*lineitem\.parquet", text)
        assert len(scans) == 1, name


def test_sql_view_leaves_no_view(spark):
    before = {t.name for t in spark.catalog.listTables()}
    E.queries()["sql_view"](spark, SF_SMALL).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_curve_and_area_use_one_window(spark):
    text = plan(E.queries()["auc"](spark, SF_SMALL), "simple")
    assert text.count("Window [") <= 2  # running sum, and the offsets of its ranges
    assert "SortMergeJoin" not in text or text.count("SortMergeJoin") == 1


def test_labelled_hand_off_prunes_columns_and_weeks(spark):
    text = plan(E.queries()["score_week_features"](spark, SF_SMALL))
    assert "ExistingRDD" not in text
    assert re.search(r"PushedFilters: \[[^\]]*week", text)


def test_no_python_udf_in_any_query_plan(spark):
    for name in ("popularity_weekly", "vocabulary", "features_indexed", "curve_binned", "typed_rows"):
        text = plan(E.queries()[name](spark, SF_SMALL), "simple")
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_labelled_hand_off_leaves_out_what_the_name_says(spark):
    """The parts of the dataset name are not written with it."""
    text = plan(E.queries()["score_week_features"](spark, SF_SMALL))
    read = re.findall(r"ReadSchema: ([^\n]*)", text)
    assert any("dataset_name" in r for r in read) and not any("datatier" in r or "primary_dataset" in r for r in read)


def test_supplier_is_joined_by_its_own_size(spark):
    """Few suppliers are broadcast from the start; accesses are not shuffled for them until their size is known."""
    text = plan(E.queries()["access_clean"](spark, SF_SMALL), "simple")
    assert text.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in text

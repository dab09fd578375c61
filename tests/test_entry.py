import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import ROOT, SF_SMALL

ROWS_ONLY = {f"train_{m}" for m in ("decision_tree", "random_forest", "gbt", "linear_svc",
                                    "logistic_regression", "linear_regression")} | {
    "score_week", "score_week_evaluation"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:2] == ["week", "dataset_name"]


def _own(named):
    """Without the queries of the removable subpackage, which has its own tests."""
    return {k: v for k, v in named.items() if k not in E.LLM_REGISTRY}


def test_every_query_has_oracle_or_is_rows_only():
    from hotsets.plans.oracle import SQL
    q, o = _own(E.queries()), _own(E.oracle_sql())
    assert set(SQL) == set(o), "oracle SQL without a registered query"
    assert set(o) <= set(q)
    assert set(q) - set(o) == ROWS_ONLY


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(_own(E.oracle_sql())))
def test_query_matches_oracle_small(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i].lower())
    got = sorted((tuple(_norm(r[i]) for i in order) for r in df.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    dorder = sorted(range(len(dcols)), key=lambda i: dcols[i].lower())
    want = sorted((tuple(_norm(r[i]) for i in dorder) for r in cur.fetchall()), key=repr)
    assert [df.columns[i].lower() for i in order] == [dcols[i].lower() for i in dorder]
    assert got == want


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) > 0
    if name.startswith("train_") or name == "score_week":
        assert df.columns[-3:] == ["label", "prediction", "score"] and "dataset_name" in df.columns
        assert {r["label"] for r in rows} <= {0.0, 1.0}
    else:
        assert df.columns == ["metric", "value"]
        m = {r["metric"]: r["value"] for r in rows}
        assert m["tp"] + m["tn"] + m["fp"] + m["fn"] == m["n"]


def test_core_queries_survive_a_missing_package():
    """Without a package that only the removable operators need, the others stay registered."""
    code = ("import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'), set(e.oracle_sql()) <= set(e.queries()))")
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.stdout.split("\n")[0] == f"{len(_own(E.queries()))} [] True", out.stderr

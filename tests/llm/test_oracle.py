import duckdb
import pytest

from hotsets.llm.oracle import SQL
from hotsets.llm.queries import REGISTRY
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(SQL[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    want = sorted(tuple(r[i] for i in at) for r in want.fetchall())
    df = REGISTRY[name](spark, SF_SMALL)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want

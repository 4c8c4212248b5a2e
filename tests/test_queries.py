"""Every registered query against its check SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.queries import load_registry
from tools.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="sample tables are not here")
REGISTRY = load_registry()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, con, name):
    df = REGISTRY[name].run(spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    sql = REGISTRY[name].check_sql()
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, rows) == rows_of(cols, cur.fetchall())

"""Every registered query with an oracle equals DuckDB on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_oracle import TABLES, norm

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Iterative studies run in the other test files; here they would only repeat that at length.
LONG = {"sensitivity_grid", "contact_compartments", "noise_matched_control", "association_study", "association_wide"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in LONG])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name not in SQL:
        return
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    idx = sorted(range(len(names)), key=lambda i: names[i])
    assert got == sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())

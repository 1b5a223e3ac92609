"""The registered queries that SQL can express against their SQL."""

import duckdb
import pytest

from meander.llm import queries

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*queries.oracle_sql()])
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    mine = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    r = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert mine and mine == sorted(str(tuple(row[names.index(c)] for c in cols)) for row in r.fetchall())

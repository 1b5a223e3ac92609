"""Every registered graph query against its SQL."""

import duckdb
import pytest

from meander import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [*catalogue.ORACLE_SQL])
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    mine = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    r = duck.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert mine and mine == sorted(str(tuple(row[names.index(c)] for c in cols)) for row in r.fetchall())

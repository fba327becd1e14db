"""Every registered raster query against its SQL in DuckDB, on the small tables."""

import os

import duckdb
import pytest

from terrastack.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canon(rows):
    return sorted((tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equal_to_oracle(spark, con, name):
    found = QUERIES[name](spark, DATA)
    rows = found.collect()
    assert rows
    if name not in ORACLE_SQL:
        return
    want = con.sql(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    types = dict(found.dtypes)
    assert {d[0]: str(d[1]) for d in want.description} == {c: KINDS[types[c]] for c in names}
    assert canon([[r[c] for c in names] for r in rows]) == canon(want.fetchall())

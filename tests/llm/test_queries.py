import os

import __spark_entry__
import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
NAMES = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n != "pipeline") == list(range(1, 14))


@pytest.mark.parametrize("name", NAMES)
def test_runs_over_the_whole_table(spark, name):
    found = __spark_entry__.queries()[name](spark, DATA)
    rows = found.collect()
    con = duckdb.connect()
    key, table, own = {"op12_html_extraction": ("page_id", "pages", "page_id"), "op13_hard_negatives": ("vec_id", "embeddings", "anchor_id")}.get(name, ("doc_id", "documents", "doc_id"))
    ids = {r[0] for r in con.sql(f"SELECT {key} FROM '{DATA}/{table}.parquet'").fetchall()}
    assert rows and {r[own] for r in rows} <= ids
    if name not in ("op3_substring_dedup", "op9_packing", "op10_license_scan", "op13_hard_negatives", "pipeline"):
        assert len(rows) == len(ids)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
        want = con.sql(sql)
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(found.columns)
        assert sorted(tuple(r[c] for c in columns) for r in rows) == sorted(want.fetchall())

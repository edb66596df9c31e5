"""Every registered query of the subpackage on the smallest tables, and the SQL of those that have one."""

from __future__ import annotations

import os

import duckdb
import pytest

from quillmetry.llm import tokenizer
from quillmetry.llm.catalog import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = {
    "p1_found": ["id", "line_no"], "p2_found": ["src", "id"], "p4_found": ["id_a", "id_b"], "p5_found": ["id"], "p6_found": ["id", "line_no"], "p7_found": ["id"],
    "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name.split("_")[0] in ("p8", "p9") and not os.path.exists(tokenizer.RANKS):
        pytest.skip("no vocabulary files")
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        if name != "p8_ids":
            assert len({tuple(r) for r in rows}) == len(rows)
    if name in ORACLE:
        con = duckdb.connect()
        con.execute(f"create view articles as select * from '{DATA}/articles.parquet'")
        assert sorted(tuple(r) for r in rows) == sorted(con.execute(ORACLE[name]).fetchall())

"""The queries on the smallest tables: columns, distinct rows, and the rows of the SQL where there is one."""

import os

import duckdb
import pytest

from spanwise.llm.oracle import ORACLE
from spanwise.llm.queries import QUERIES

TABLES = os.environ.get("SPANWISE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")

COLUMNS = {
    "p1_found": ["doc_id", "cut"],
    "p2_found": ["answer_id", "defect"],
    "p3_found": ["root_qid", "qid"],
    "p4_found": ["qid_a", "qid_b"],
    "p5_found": ["doc_id", "sent_start"],
    "p6_found": ["tab", "row_key", "field"],
    "p7_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "seg_start", "lang"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, TABLES)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name in ORACLE:
        c = duckdb.connect()
        for t in os.listdir(TABLES):
            p = os.path.join(TABLES, t)
            c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
        want = c.execute(ORACLE[name]).df()[df.columns]
        assert sorted(rows) == sorted(tuple(map(str, r)) for r in want.itertuples(index=False))

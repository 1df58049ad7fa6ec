"""Cut-offs of the registered queries: heads of 1000, as the reference takes them."""

import os

import duckdb
import pytest

from conftest import SF_MID
from test_oracle_small import _digest

import __spark_entry__ as entry


@pytest.mark.parametrize("key", ["j3_semi_restrict_topk", "e1_f11", "e2_f12_score", "j5_topk_overlap", "u2_intersect"])
def test_heads_of_1000(spark, key):
    """The oracle's query at sf0.01, whose tables have more rows than a head of a few hundred."""
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_MID, t)}.parquet')")
    df = entry.queries()[key](spark, SF_MID)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[key])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert _digest(df.columns, rows) == _digest(columns, cur.fetchall())

"""Training-data queries with SQL agree with DuckDB at sf0.001; the others are listed."""

import duckdb
import pytest

from tessera.llm.registry import ORACLES, QUERIES
from tools.check_oracles import TABLES, digest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[key])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert sorted(df.columns) == sorted(cols) and len(rows) == len(want)
    assert digest(df.columns, rows)[0] == digest(cols, want)[0]


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == {"op2_langid", "op4_jaccard", "op5_imatch", "op6_quality", "op7_bpe", "op9_ann", "op10_tokens"}

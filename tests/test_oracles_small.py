"""Every registered query with an oracle agrees with DuckDB at sf0.001."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from tessera.plans.registry import ORACLES, QUERIES  # noqa: E402
from tools.check_oracles import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["split", "batch_id", "block_no", "n_tokens", "ids_md5"]


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLES[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    spark_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    duck_types = {d[0]: str(t) for d, t in zip(res.description, con.sql(ORACLES[key]).types)}
    assert spark_types == duck_types
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_oracle_or_is_listed():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only <= {"learn_bpe", "encode_bpe"}

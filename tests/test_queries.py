"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from millrace.plans import ORACLE, QUERIES
from millrace.sources import SCHEMAS

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in SCHEMAS:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert sorted(map(repr, (tuple(r) for r in got.select(*[f"`{c}`" for c in cols]).collect()))) == sorted(map(repr, con.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

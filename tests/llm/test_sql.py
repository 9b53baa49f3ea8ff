"""Queries with SQL against that SQL on the small tables."""

import glob
import os

import duckdb
import pytest

from evispark.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = plain(df.collect(), df.columns)
    assert got and got == plain(want.fetchall(), want.columns)

"""Every query with SQL against that SQL, on the small tables; every other query runs."""

import glob
import math
import os

import duckdb
import pytest

from evispark.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5)
    if type(v).__name__ == "Decimal":
        return round(float(v), 5)
    return str(v)


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in order] for r in records), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.collect(), df.columns)
    if name in ORACLE:
        found = duck.sql(ORACLE[name])
        assert sorted(df.columns) == sorted(found.columns)
        assert got == rows(found.fetchall(), found.columns)


def test_plans_have_no_cartesian_products(spark):
    for name in ("k14_scored_edges", "k26_conflicts", "p04_candidates", "d05_simhash_pairs", "n19_cooccurrences"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan

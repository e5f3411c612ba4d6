"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

FOLDER = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
# those of a subpackage with tests of its own are left to them
OWN = set(entry_point.LLM_QUERIES)
QUERIES = {k: v for k, v in entry_point.queries().items() if k not in OWN}
CHECKS = {k: v for k, v in entry_point.oracle_sql().items() if k not in OWN}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, list):
        return tuple(plain(v) for v in value)
    return value


def in_order(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    result = duck.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert in_order(df.collect(), df.columns) == in_order(result.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_learned_query_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 100

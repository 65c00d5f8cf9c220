"""Every query against the same query in DuckDB, on the same Parquet tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.plans.oracle import ORACLE_SQL
from tidemark.plans.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


EMPTY = {"gold_of_no_tickets"}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, duck, name):
    found = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    expected = result.fetchall()
    assert sorted(found.columns) == sorted(columns)
    assert bool(expected) == (name not in EMPTY)
    types = dict(found.dtypes)
    assert types == {c[0]: TYPES[str(c[1])] for c in result.description}
    got = _rows(found.columns, [tuple(r) for r in found.collect()])
    assert got == _rows(columns, expected)

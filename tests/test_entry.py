"""The driver contract, on the smallest tables where they are present."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from checks.verify import TABLES, _rows

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_has_rows(spark):
    frame = contract.entry(spark)
    assert frame.columns == ["message_id", "score", "level"] and frame.count() > 0


@pytest.mark.parametrize("name", ["assessments", "ttl_lookup", "url_observations", "normalize_messages", "hosting_matches"])
def test_query_agrees_with_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    frame = contract.queries()[name](spark, SF_DIR)
    answer = db.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(frame.columns)
    assert _rows(frame.columns, frame.collect()) == _rows(columns, answer.fetchall())

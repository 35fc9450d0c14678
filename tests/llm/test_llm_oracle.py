"""Registered queries against the SQL that states their results."""

from __future__ import annotations

import os

import duckdb
import pytest

from tapelake.llm.oracle import SQL
from tapelake.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", SQL)
def test_query_equals_sql(spark, name):
    with duckdb.connect() as db:
        for table in ("documents", "benchmark", "conversations", "embeddings"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        want = db.sql(SQL[name])
        columns = sorted(want.columns)
        stated = sorted(want.select(*columns).fetchall())
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == stated

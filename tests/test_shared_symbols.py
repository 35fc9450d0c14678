"""Events of users who share a symbol, as there are in tables of more than ten thousand users, against the queries' SQL."""

from __future__ import annotations

import collections

import duckdb
import pytest

from tapelake.plans.oracle import SQL
from tapelake.plans.queries import QUERIES

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.mark.parametrize("name", ["ingest_file_problems", "ingest_receipts", "ingest_row_counts"])
def test_users_of_one_symbol(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT e.* REPLACE (event_id + 1000 * i AS event_id, user_id + 10000 * i AS user_id)
        FROM '{EVENTS}' e, range(3) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    names = sorted(df.columns)
    got = collections.Counter(tuple(r) for r in df.select(*names).collect())
    assert got == collections.Counter(con.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})").fetchall())

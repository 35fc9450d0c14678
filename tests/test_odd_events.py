"""Events that lack something, against the queries' SQL."""

from __future__ import annotations

import collections

import duckdb

from tapelake.plans.oracle import SQL
from tapelake.plans.queries import QUERIES

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_lines_without_a_day_are_counted_with_their_rows(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 5 <> 2 THEN ts END AS ts) FROM '{EVENTS}')
        TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    df = QUERIES["ingest_row_counts"](spark, str(tmp_path))
    names = sorted(df.columns)
    got = collections.Counter(tuple(r) for r in df.select(*names).collect())
    assert got == collections.Counter(con.execute(f"SELECT {', '.join(names)} FROM ({SQL['ingest_row_counts']})").fetchall())

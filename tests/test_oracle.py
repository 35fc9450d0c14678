"""Every registered query against its SQL on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as contract
from tapelake.plans import queries
from tapelake.plans.oracle import SQL
from tapelake.plans.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(v[i] for i in order) for v in values), key=repr)


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) == set(SQL) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    check(duck, name, QUERIES[name](spark, SF_DIR))


@pytest.mark.parametrize("parts", [7, 100])
def test_place_does_not_depend_on_part_files(spark, duck, monkeypatch, parts):
    whole = queries.event_store
    monkeypatch.setattr(queries, "event_store", lambda s, d: whole(s, d, parts))
    check(duck, "store_order", QUERIES["store_order"](spark, SF_DIR))


def check(duck, name, df):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(SQL[name])
    want = rows([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_has_rows(spark):
    assert contract.entry(spark).columns == ["day", "symbol", "time_ms", "seq", "price", "vol", "ask_ref", "bid_ref"]

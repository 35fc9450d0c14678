"""The tables kept beside a store: what is opened and scanned, and what is not."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tapelake.schema import STREAMS, ReadRequest
from tapelake.sources import raw_store, store_index
from tapelake.sources.raw_store import RawStore, StoreError
from tapelake.sources.registry import parse_registry
from tests.conftest import PLAIN, REGISTRY, RESCUED, random_rows, save

SYMBOLS = ("000000.SZ", "000000.SH", "000858.SZ", "016384.SZ", "600519.SH", "999999.SH")
LATER = dt.date(2023, 5, 11)


@pytest.fixture
def store(spark, market):
    rng = random.Random(3)
    for s in STREAMS:
        save(market, s, PLAIN, random_rows(rng, s, SYMBOLS[:3], 30), row_group_size=7)
        save(market, s, RESCUED, random_rows(rng, s, SYMBOLS[1:5], 20), row_group_size=7)
    return RawStore(spark, str(market), parse_registry(spark, REGISTRY))


@pytest.fixture
def opened(monkeypatch):
    """Numbers of files handed over to be opened, call by call."""
    calls: list[int] = []
    whole = store_index.file_footers
    monkeypatch.setattr(store_index, "file_footers", lambda files: calls.append(files.count()) or whole(files))
    return calls


def test_footers_are_opened_once(store, market, opened):
    request = ReadRequest("orders", (PLAIN, RESCUED), ("oid",))
    store.read(request)
    assert opened == [2]
    assert store.read(request).stats.first()["row_groups_total"] > 2
    store.catalog("orders", (PLAIN, LATER)).footers.collect()
    assert opened == [2]
    save(market, "orders", LATER, random_rows(random.Random(4), "orders", SYMBOLS, 9))
    store.read(ReadRequest("orders", (PLAIN, RESCUED, LATER), ("oid",)))
    assert opened == [2, 1]


def test_a_file_that_changed_is_opened_again(store, market, opened):
    request = ReadRequest("orders", (PLAIN,), ("oid",), symbols=frozenset({SYMBOLS[4]}))
    store.build_index()
    assert [r.symbol for r in store.read(request).gaps.collect()] == [SYMBOLS[4]]
    rows = random_rows(random.Random(5), "orders", SYMBOLS[4:5], 12)
    save(market, "orders", PLAIN, rows)
    assert store.read(request).gaps.collect() == [] and opened == [6, 1]
    pq.write_table(pa.table({"column_6": ["1"]}), market / "orders" / f"date={PLAIN:%Y%m%d}.parquet")
    with pytest.raises(StoreError, match="lacks _symbol"):
        store.read(request)


def test_gaps_from_bitmaps_scan_nothing(store, monkeypatch):
    request = ReadRequest("trades", (PLAIN, LATER, RESCUED), ("seq",), symbols=frozenset(SYMBOLS))
    scanned = sorted(tuple(r) for r in store.read(request).gaps.collect())
    store.build_index()
    store.build_index()
    gaps = store.read(request).gaps
    assert "trades/date=" not in gaps._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in gaps.collect()) == scanned and len(scanned) > 4
    files = raw_store.store_files(store.spark, store.root)
    assert store_index.unrecorded(files, store.root).isEmpty()


def test_gaps_mix_bitmaps_and_scans(store, market):
    store.build_index()
    rows = random_rows(random.Random(6), "orders", SYMBOLS[5:], 5)
    save(market, "orders", LATER, rows)
    found = store.read(ReadRequest("orders", (PLAIN, LATER), ("oid",), symbols=frozenset(SYMBOLS[4:]))).gaps.collect()
    assert {(r.day, r.symbol) for r in found} == {(PLAIN, SYMBOLS[4]), (PLAIN, SYMBOLS[5]), (LATER, SYMBOLS[4])}


def test_files_without_symbols_are_recorded(store, market):
    save(market, "orders", LATER, [])
    store.build_index()
    request = ReadRequest("orders", (LATER,), ("oid",), symbols=frozenset(SYMBOLS[:2]))
    assert {r.symbol for r in store.read(request).gaps.collect()} == set(SYMBOLS[:2])
    assert store_index.unrecorded(raw_store.store_files(store.spark, store.root), store.root).isEmpty()


def test_symbol_numbers(spark):
    names = [*SYMBOLS, "600519.HK", "60051.SH", "x00000.SZ", "", None]
    rows = spark.createDataFrame([(s,) for s in names], "s string").select("s", store_index.symbol_number(F.col("s")).alias("n")).collect()
    assert [r.n for r in rows] == [0, 1, 1716, 32768, 1201039, 1999999, None, None, None, None, None]
    made = spark.range(70000).select(store_index.bucket_of(F.col("id")).alias("b"), (F.col("id") % store_index.BUCKET).alias("p"))
    maps = made.filter("p % 3 = 0").groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    bad = made.join(maps, "b").filter(store_index.has_bit(F.col("bits"), F.col("p").cast("int")) != (F.col("p") % 3 == 0))
    assert bad.isEmpty()


def test_index_elsewhere(spark, store, market, tmp_path):
    other = RawStore(spark, str(market), store.registry, str(tmp_path / "index"))
    other.build_index()
    assert (tmp_path / "index/footers").exists() and not (market / "_index").exists()
    assert other.days() == (PLAIN, RESCUED)

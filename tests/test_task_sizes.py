"""Stores are written by as many tasks as their cells ask for."""

from __future__ import annotations

from tapelake.plans import encode
from tapelake.sources.raw_store import store_files


def test_parts_go_by_cells(spark, monkeypatch):
    monkeypatch.setattr(encode, "_CELLS_PER_TASK", 4000)
    root = encode.event_store(spark, "/root/testdata/sf0.001", altered=True)
    encode._STORES.clear()
    parts = {r["stream"]: r["n"] for r in store_files(spark, root).selectExpr("stream", "regexp_extract(path, 'part-([0-9]+)', 1) AS p")
             .distinct().groupBy("stream").count().withColumnRenamed("count", "n").collect()}
    # 200 quotes of 67 columns, 400 orders of 11
    assert parts["xinqing"] >= 3 and parts["orders"] == 2

"""Symbols become bitmaps with little work a row."""

from __future__ import annotations

import random

from conftest import PLAIN, random_rows, save

from tapelake.schema import STREAMS, SYMBOL_COL
from tapelake.sources import store_index
from tapelake.sources.raw_store import index_store

SYMBOLS = ("000001.SZ", "000001.SH", "016384.SZ", "600519.SH", "999999.SH", "odd")


def test_a_rows_symbol_is_matched_once_and_its_file_after_grouping(spark, market, monkeypatch):
    plans = []
    append = store_index.append_rows

    def noted(rows, path):
        if path.endswith("/presence"):
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        append(rows, path)

    monkeypatch.setattr(store_index, "append_rows", noted)
    rng, rows = random.Random(7), {}
    for stream in STREAMS:
        rows[stream] = random_rows(rng, stream, SYMBOLS, 40)
        save(market, stream, PLAIN, rows[stream])
    index_store(spark, str(market))

    assert len(plans) == len(STREAMS)
    for plan in plans:
        below = plan[plan.index("bitmap_construct_agg"):]       # a plan's text goes from the top down
        assert below.count("RLIKE(") == 1 and "/date=.*)$" not in below.partition("FileScan")[0].partition("Relation")[0]
    stored = store_index.stored_table(spark, f"{store_index.index_path(spark, str(market))}/presence", store_index.PRESENCE)
    counts = {r["rel"].split("/")[0]: r["n"] for r in stored.selectExpr("rel", "bitmap_count(bits) AS n").groupBy("rel").sum("n")
              .withColumnRenamed("sum(n)", "n").collect()}
    assert counts == {s: len({r[SYMBOL_COL] for r in rows[s]} - {"odd"}) for s in STREAMS}

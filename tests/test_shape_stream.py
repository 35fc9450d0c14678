"""Time shapes of published days, by a stream that stops and starts."""

from __future__ import annotations

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tapelake.operators import shape_stream
from tapelake.operators.audit import scan_streams, time_shapes
from tapelake.operators.shape_stream import stream_time_shapes, streamed_shapes
from tapelake.schema import STREAMS, TIME_COL
from tapelake.sources.raw_store import stored_days
from tapelake.sources.snapshots import commit, snapshot

FIRST, SECOND, THIRD = (dt.date(2023, 6, d) for d in (1, 2, 5))


def publish(spark, root, run, days, times):
    base = snapshot(spark, str(root))
    for stream in STREAMS:
        for day in days:
            folder = root / stream / f"v={run}" / f"date={day:%Y%m%d}"
            folder.mkdir(parents=True)
            pq.write_table(pa.table({TIME_COL: pa.array(times, pa.string()), "_symbol": ["s"] * len(times)}), folder / "part-0.parquet")
    commit(spark, str(root), days, run, base)


def test_every_published_day_counts_once(spark, market, tmp_path, monkeypatch):
    root, out, marks = str(market), str(tmp_path / "out"), str(tmp_path / "marks")

    def agree():
        rows = scan_streams(spark, root, stored_days(spark, root), ["_symbol", TIME_COL])
        want = sorted(tuple(r) for r in time_shapes(rows).collect())
        assert sorted(tuple(r) for r in streamed_shapes(spark, root, out).collect()) == want
        return want

    publish(spark, market, "r1", [FIRST, SECOND], ["93000000", " 101500000 ", None, ""])
    publish(spark, market, "r2", [SECOND], ["101500000"])       # before the stream has seen the first version
    whole = shape_stream._record

    def dies(*args):
        whole(*args)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(shape_stream, "_record", dies)
    with pytest.raises(Exception, match="lost after the write"):
        stream_time_shapes(spark, root, out, marks)
    monkeypatch.setattr(shape_stream, "_record", whole)
    stream_time_shapes(spark, root, out, marks)                 # the same batch once more
    assert (FIRST, "orders", -1, 1) in agree()
    publish(spark, market, "r3", [FIRST, THIRD], ["101500"])    # replaces a recorded day
    stream_time_shapes(spark, root, out, marks)
    assert {r[0] for r in agree()} == {FIRST, SECOND, THIRD}
    files = sorted((tmp_path / "out").rglob("part-*"))
    stream_time_shapes(spark, root, out, marks)                 # nothing new
    agree()
    assert sorted((tmp_path / "out").rglob("part-*")) == files

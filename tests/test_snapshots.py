"""Versions of a store: what readers see whatever happens to a writer."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tapelake.operators import ingest as ingest_module
from tapelake.sources.raw_store import RawStore, stored_days
from tapelake.operators.ingest import ingest, ingest_days, manifests
from tapelake.schema import STREAMS, ReadRequest
from tapelake.sources import snapshots
from tapelake.sources.registry import parse_registry
from tapelake.sources.snapshots import Snapshot, SnapshotConflict, commit, snapshot, vacuum, versions
from tests.conftest import PLAIN, REGISTRY, random_rows, save
from tests.test_ingest import put_source, source_files

DAYS = (dt.date(2023, 6, 1), dt.date(2023, 6, 2))


@pytest.fixture
def sources(tmp_path):
    return [put_source(tmp_path / f"{d:%Y%m%d}.7z", source_files({"600519.SH": 2 + i}), d) for i, d in enumerate(DAYS)]


def seen(spark, root, version=None):
    """{day: rows of the orders} of the days that are complete, and the days with a manifest."""
    store = RawStore(spark, str(root), parse_registry(spark, REGISTRY), version=version)
    days = store.days()
    rows = store.read(ReadRequest("orders", days, ("oid",))).frame.groupBy("day").count().collect() if days else []
    return {r["day"]: r["count"] for r in rows}, sorted(r["day"] for r in store.manifests().collect())


def test_days_come_in_together(spark, market, sources):
    assert ingest_days(spark, sources, str(market)).ok
    assert versions(spark, str(market)) == [1] and set(snapshot(spark, str(market)).runs) == set(DAYS)
    assert seen(spark, market) == ({DAYS[0]: 2, DAYS[1]: 3}, list(DAYS))
    assert stored_days(spark, str(market)) == DAYS


@pytest.mark.parametrize("step", ["_write_streams", "_output_digests", "_miscounted", "index_store", "_receipts", "commit"])
def test_a_writer_that_dies_changes_nothing(spark, market, sources, step, monkeypatch):
    """The run stops at a step after having done it, but for the last one, which it does not begin."""
    old = random_rows(random.Random(1), "orders", ("000858.SZ",), 5)
    for s in STREAMS:
        save(market, s, DAYS[0], old if s == "orders" else random_rows(random.Random(2), s, ("000858.SZ",), 5))
    before = seen(spark, market)
    assert before == ({DAYS[0]: 5}, [])
    whole = getattr(ingest_module, step)

    def dies(*args, **kw):
        if step != "commit":
            whole(*args, **kw)
        raise KeyboardInterrupt

    monkeypatch.setattr(ingest_module, step, dies)
    with pytest.raises(KeyboardInterrupt):
        ingest_days(spark, sources, str(market))
    assert seen(spark, market) == before and manifests(spark, str(market)).isEmpty()
    monkeypatch.setattr(ingest_module, step, whole)
    assert ingest_days(spark, sources, str(market)).ok
    assert seen(spark, market) == ({DAYS[0]: 2, DAYS[1]: 3}, list(DAYS))


def test_readers_stay_with_their_version(spark, market, sources):
    ingest(spark, DAYS[0], sources[0], str(market))
    reader = RawStore(spark, str(market), parse_registry(spark, REGISTRY))
    ingest(spark, DAYS[1], sources[1], str(market))
    assert reader.days() == DAYS[:1] and seen(spark, market)[1] == list(DAYS)
    assert seen(spark, market, 1) == ({DAYS[0]: 2}, [DAYS[0]])
    with pytest.raises(ValueError, match="no version 9"):
        RawStore(spark, str(market), reader.registry, version=9)


def test_two_writers(spark, market, monkeypatch):
    root = str(market)
    base = snapshot(spark, root)
    assert base == Snapshot(0, {})
    commit(spark, root, [DAYS[0]], "first", base)
    assert commit(spark, root, [DAYS[1]], "second", base) == Snapshot(2, {DAYS[0]: "first", DAYS[1]: "second"})
    with pytest.raises(SnapshotConflict, match=str(DAYS[0])):
        commit(spark, root, [DAYS[0]], "third", base)
    assert commit(spark, root, [DAYS[0]], "third", snapshot(spark, root)).runs[DAYS[0]] == "third"
    # The number is taken between looking and writing.
    whole, raced = snapshots.claim, []

    def race(s, r, version, content):
        if not raced:
            raced.append(whole(s, r, version, {"runs": {str(PLAIN): "other", str(DAYS[0]): "third", str(DAYS[1]): "second"}}))
        return whole(s, r, version, content)

    monkeypatch.setattr(snapshots, "claim", race)
    now = commit(spark, root, [DAYS[1]], "fourth", snapshot(spark, root))
    assert raced == [True] and now == Snapshot(5, {PLAIN: "other", DAYS[0]: "third", DAYS[1]: "fourth"}) == snapshot(spark, root)
    assert not list((market / "_versions").glob("*.tmp"))


def test_vacuum_removes_what_no_kept_version_names(spark, market, sources, monkeypatch):
    root = str(market)
    ingest(spark, DAYS[0], sources[0], root)
    first = snapshot(spark, root).runs[DAYS[0]]
    monkeypatch.setattr(ingest_module, "commit", lambda *a: None)
    ingest_days(spark, sources[1:], root)
    parts = (*STREAMS, "manifest")
    assert vacuum(spark, root, parts) == []
    gone = vacuum(spark, root, parts, older_than=dt.timedelta(0))
    assert len(gone) == 4 and not any(first in g for g in gone)
    assert seen(spark, market) == ({DAYS[0]: 2}, [DAYS[0]])

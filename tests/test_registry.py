"""Registry: row rules, chains, lookup, snapshots, observations."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest

from tapelake.operators.registry_lookup import entries_for, patches_for, with_defects
from tapelake.operators.registry_rules import (DEFECT_CODES, batch_problems, chain_problems, code_set_difference,
                                               rule_problems, snapshot_problems, unregistered_codes)
from tapelake.sources.registry import HANDLED_PATCHES, RegistryError, parse_registry, registry_rows
from tests.conftest import REGISTRY, SHORT, entry

FULL = "".join(entry(f"D{i:03d}", c) for i, c in enumerate(DEFECT_CODES, 1))


def problems(spark, text, **kw):
    return {(r["id"], r["problem"]) for r in rule_problems(registry_rows(spark, text), **kw).collect()}


def test_clean_registry_parses_and_is_digested(spark):
    got = parse_registry(spark, REGISTRY)
    assert got.sha256 == hashlib.sha256(REGISTRY.encode()).hexdigest() and got.entries.count() == 3


@pytest.mark.parametrize(("text", "problem"), [
    ('[[defect]]\nid = "D1"\ncode = "time_6digit"\n', "missing kind"),
    (entry("D1", "seq_empty", stream="bonds"), "unknown stream"),
    (entry("D1", "no_such_code"), "unknown code"),
    (entry("D1", "seq_empty", status="odd"), "kind, status or action outside its values"),
    (entry("D1", "seq_empty", ("2024-02-06T00:00:00Z",)), "days hold no exact date"),
    (entry("D1", "seq_empty", created_at='"2026-9-1"'), "created_at is no exact date"),
    (entry("D1", "seq_empty", None, read_layer_action="gap"), "patch and gap need days"),
    (entry("D1", "seq_empty", superseded_by="D2"), "superseded and superseded_by go together"),
    (entry("D1", "seq_empty", status="superseded"), "superseded and superseded_by go together"),
    (entry("D1", "seq_empty", kind="shape"), "an active shape needs decision_ref"),
    (entry("D1", "seq_empty", evidence_sha256="A" * 64), "evidence_sha256 is no digest"),
    (entry("D1", "seq_empty") * 2, "repeated id"),
])
def test_each_rule(spark, text, problem):
    assert ("D1", problem) in problems(spark, text)
    with pytest.raises(RegistryError, match="D1"):
        parse_registry(spark, text)


def test_review_rules(spark):
    assert ("D1", "patch code without handler") in problems(spark, entry("D1", "seq_empty", read_layer_action="patch"),
                                                          handled=HANDLED_PATCHES)
    assert ("D1", "decision_ref and decision_sha256 go together") in problems(spark, entry("D1", "seq_empty", decision_ref="d"),
                                                                           handled=HANDLED_PATCHES)
    assert ("D1", "decision_ref repeats evidence") in problems(
        spark, entry("D1", "seq_empty", decision_ref="docs/e.md", decision_sha256="0" * 64), handled=HANDLED_PATCHES)
    assert problems(spark, FULL, handled=HANDLED_PATCHES) == set()


def test_superseded_codes_need_not_be_known(spark):
    text = FULL + entry("D900", "gone_code", status="superseded", superseded_by="D001")
    assert parse_registry(spark, text).entries.count() == len(DEFECT_CODES) + 1


def chain(spark, *links):
    rows = [(i, s, n) for i, s, n in links]
    df = spark.createDataFrame(rows, "id string, status string, superseded_by string")
    return {r["id"]: r["problem"] for r in chain_problems(df).collect()}


def test_chains(spark):
    broken, circle, dead = "supersede chain is broken", "supersede chain circles", "supersede chain ends in no live entry"
    assert chain(spark, ("a", "active", None)) == {}
    assert chain(spark, ("a", "superseded", "a")) == {"a": circle}
    assert chain(spark, ("a", "superseded", "x")) == {"a": broken}
    assert chain(spark, ("a", "superseded", "b"), ("b", "rejected", None)) == {"a": broken}
    assert chain(spark, ("a", "superseded", "b"), ("b", "superseded", "c"), ("c", "pending", None)) == {}
    assert chain(spark, ("a", "superseded", "b"), ("b", "superseded", None)) == {"a": dead}
    assert chain(spark, ("a", "superseded", "b"), ("b", "superseded", "c"), ("c", "superseded", "b"), ("d", "superseded", "e"),
                 ("e", "active", None)) == {"a": circle, "b": circle, "c": circle}
    long = [(str(i), "superseded", str(i + 1)) for i in range(50)]
    assert chain(spark, *long, ("50", "active", None)) == {}
    assert chain(spark, *long) == {str(i): broken for i in range(50)}


def test_lookup_by_day_and_stream(spark):
    text = (entry("D1", "rescue_partial", ("2022-01-04",), stream="orders") + entry("D2", "seq_empty", ("2022-01-04",), stream="trades")
            + entry("D3", "time_6digit") + entry("D4", "enum_drift", None) + entry("D5", "rescue_partial", ("2022-01-04",))
            + entry("D6", "quote_only", ("2022-01-04",), read_layer_action="none")
            + entry("D7", "seq_sparse_dup", ("2022-01-04",), status="pending"))
    entries = parse_registry(spark, text).entries
    day, day6 = dt.date(2022, 1, 4), SHORT
    keys = spark.createDataFrame([(d, s) for d in (day, day6) for s in ("orders", "trades")], "day date, stream string")
    got = {}
    for r in entries_for(keys, entries).sort("pos").collect():
        got.setdefault((r["day"], r["stream"]), []).append(r["id"])
    assert got == {(day, "orders"): ["D1", "D4", "D5", "D6"], (day, "trades"): ["D2", "D4", "D5", "D6"],
                   (day6, "orders"): ["D3", "D4"], (day6, "trades"): ["D3", "D4"]}
    defects = {(r["day"], r["stream"]): r["defects"] for r in with_defects(keys, entries).collect()}
    assert defects == {(day, "orders"): ["rescue_partial"], (day, "trades"): ["seq_empty", "rescue_partial"],
                       (day6, "orders"): ["time_6digit"], (day6, "trades"): ["time_6digit"]}
    assert {(r["day"], r["stream"], r["code"]) for r in patches_for(keys, entries).collect()} == {
        (day6, "orders", "time_6digit"), (day6, "trades", "time_6digit")}


def snapshot(spark, old, new):
    return {(r["id"], r["problem"]) for r in snapshot_problems(registry_rows(spark, old), registry_rows(spark, new)).collect()}


def test_snapshots_only_append(spark):
    old = entry("D1", "seq_empty")
    assert snapshot(spark, old, old) == set() and snapshot(spark, old, "") == {("D1", "entry deleted")}
    for key, value in (("evidence", "x"), ("created_at", "2026-09-02"), ("note", "n"), ("read_layer_action", "none"), ("kind", "shape")):
        before = entry("D1", "seq_empty", note="m")
        assert snapshot(spark, before, entry("D1", "seq_empty", **{"note": "m", key: value})) == {("D1", f"{key} changed")}
    assert snapshot(spark, old, entry("D1", "seq_empty", note="first note")) == set()      # fields may be added
    assert snapshot(spark, old, entry("D1", "seq_empty", (str(SHORT), "2024-02-08"))) == set()
    assert snapshot(spark, old, entry("D1", "seq_empty", ("2024-02-08",))) == {("D1", "days removed")}
    structural = entry("D1", "enum_drift", None)
    assert snapshot(spark, structural, entry("D1", "enum_drift", read_layer_action="none")) == {
        ("D1", "structural entry narrowed to days")}
    assert snapshot(spark, structural, entry("D1", "enum_drift", None, stream="orders")) == {("D1", "stream scope changed")}
    assert snapshot(spark, old, old + entry("D2", "x", status="pending")) == set()
    assert snapshot(spark, old, old + entry("D2", "x")) == {("D2", "new entry not pending")}


@pytest.mark.parametrize(("before", "after", "ok"), [
    ("pending", "active", True), ("active", "superseded", True), ("pending", "rejected", True), ("pending", "superseded", False),
    ("active", "pending", False), ("superseded", "active", False), ("rejected", "active", False)])
def test_status_changes(spark, before, after, ok):
    def of(status):
        return entry("D1", "seq_empty", status=status, superseded_by="D2" if status == "superseded" else None)
    found = {p for _, p in snapshot(spark, of(before), of(after))}
    assert ("status change not allowed" in found) is not ok


def test_codes_and_batches(spark):
    registry = registry_rows(spark, entry("D1", "seq_empty") + entry("D2", "rescue_partial", status="pending")
                             + entry("D3", "quote_only", status="rejected"))
    observed = spark.createDataFrame([("seq_empty",), ("rescue_partial",), ("quote_only",), ("never",)], "code string")
    assert {r["code"] for r in unregistered_codes(observed, registry).collect()} == {"quote_only", "never"}
    assert {(r["code"], r["side"]) for r in code_set_difference(observed.limit(1), registry).collect()} == {
        ("rescue_partial", "registry only")}

    def batch(**kw):
        row = {"file": "a.toml", "sha256": "s", "scanner": "external:x", "scanner_sha256": "a" * 64, "input": "i",
               "input_sha256": "0", "scanned_at": "2026-09-02"} | kw
        return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))

    def files(*rows):
        return spark.createDataFrame(list(rows), "file string, sha256 string, codes array<string>")

    def found(*args, **kw):
        return {r["problem"] for r in batch_problems(*args, **kw).collect()}

    good = files(("a.toml", "s", ["seq_empty", "rescue_partial"]))
    assert found(batch(), good, registry) == set() and found(batch(), good, registry, old=batch()) == set()
    assert found(batch(), files(("a.toml", "t", [])), registry) == {"file altered"}
    assert found(batch(file="../a.toml"), good, registry) == {"file is no plain name", "file missing", "file in no batch"}
    assert found(batch(), files(("a.toml", "s", ["never"])), registry) == {"unregistered code never"}
    assert found(batch(), files(("a.toml", "s", []), ("b.toml", "s", [])), registry) == {"file in no batch"}
    assert found(batch(input="j"), good, registry, old=batch()) == {"earlier batch changed or removed"}
    assert found(batch(scanner="scripts/x"), good, registry) == {"scanner is neither a tool nor external"}
    zero = batch(scanner_sha256="0" * 64)
    assert found(zero, good, registry) == {"external scanner without digest"} and found(zero, good, registry, old=zero) == set()

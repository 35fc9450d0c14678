"""Conversation repair against a search over all edits."""

from __future__ import annotations

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest

from tapelake.llm import conversation_repair as repair

ROWS = "conv_id long, turn long, role string, text string, extra string"


def cheapest(rows):
    """(cost, audit, repaired rows) of (role, text, fault) rows, by the cheapest and then least edit string."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        if (at, last) in done:
            continue
        done.add((at, last))
        made = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 5, audit + "I", at, made[0], (*out, (made, ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, out))
        if fault not in ("blank", "duplicate"):
            more = 5 if fault == "truncated" else 0
            heapq.heappush(heap, (cost + 1 + more, audit + "R", at + 1, made[0], (*out, (made, text))))
            if role[:1] in {"": "su", "s": "u", "u": "a", "a": "u"}[last] and role:
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, role[0], (*out, (role, text))))
    raise AssertionError


def expected(rows):
    """Result rows of a conversation's rows (turn, role, text) in any order."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    order = lambda row: (row[0] is not None, row[0] or 0, hashlib.md5(f"{len(row[1])}:{row[1]}{row[2]}".encode()).digest())
    rows.sort(key=order)
    seen, faulty = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faulty.append((role, text, fault))
    cost, audit, out = cheapest(faulty)
    turns = {t for t, _, _ in rows if t is not None}
    faults = collections.Counter(f for _, _, f in faulty)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _, _), (b, _, _) in zip(faulty, faulty[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            illegal, cost, audit, digest), out


def damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv] += [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (
            0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain(rows):
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.fixture
def table():
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "sys", "usher"]
    texts = ["Yes.", "No!", "What? ", "cut off", "", " \t\n", None, "Ends.\n", "wie schön.", "x　", "!", "Yes."]
    rows = [(c, rng.choice([None, *range(6)]) if c % 5 == 0 else t, rng.choice(roles), rng.choice(texts), "clash")
            for c in range(60) for t in range(rng.randrange(1, 12))]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    return [*rows, *rows[:5], (gone, 1, "user", "All of it.", ""), (None, None, None, None, None), (None, 1, "user", "Hi.", ""), (900, 1, "user", "word " * 30000, ""),
            *[(901, 1, "user", "Same.", "")] * 40]


def test_tables_against_search():
    rng, tables = random.Random(1), [repair.Tables(1), repair.Tables(3), repair.Tables()]
    names = ["system", "user", "assistant", "x"]
    for n in range(600):
        symbols = bytes(rng.randrange(9) for _ in range(n % 15))
        want = cheapest([(names[s >> 1], "", "truncated" if s & 1 else "") if s < 8 else ("user", "", "blank") for s in symbols])[:2]
        for t in tables:
            cost, edits = t.traced(symbols)
            assert (cost, "".join(edits)) == want


@pytest.mark.parametrize("segment", [2, 4096])
def test_audit_against_search(spark, table, segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = spark.createDataFrame(table, ROWS).repartition(4)
    own = collections.defaultdict(list)
    for conv, turn, role, text, _ in table:
        own[conv].append((turn, role, text))
    got = plain(repair.audited(rows).collect())
    assert got == {c: expected(x)[0] for c, x in own.items()}
    out = collections.defaultdict(list)
    for r in sorted(repair.repaired(rows).collect(), key=lambda r: r.place):
        out[r.conv_id].append((r.role, r.text))
    assert out == {c: e for c, x in own.items() if (e := expected(x)[1])}
    for x in out.values():
        assert re.fullmatch("s?(ua)+", "".join(r[0] for r, _ in x))


def test_damaged_conversations(spark, table):
    got = plain(repair.audited(repair.damaged(spark.createDataFrame(table, ROWS))).collect())
    broken = damage(table)
    assert got == {c: expected(broken[c])[0] for c in {r[0] for r in table}}
    empty = next(c for c in got if not broken[c])
    assert got[empty] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_conversations(spark):
    none = spark.createDataFrame([], ROWS)
    assert repair.audited(repair.damaged(none)).collect() == [] and repair.repaired(none).collect() == []


def test_sql_agrees_on_odd_rows(spark, table):
    import duckdb
    import pandas as pd

    from tapelake.llm.oracle import SQL

    frame = pd.DataFrame(table, columns=["conv_id", "turn", "role", "text", "extra"])
    with duckdb.connect() as db:
        db.register("frame", frame)
        db.execute("CREATE VIEW conversations AS SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM frame")
        stated = {r[0]: tuple(r[1:]) for r in db.execute(SQL["op11_four_russians"]).fetchall()}
    assert plain(repair.audited(repair.damaged(spark.createDataFrame(table, ROWS))).collect()) == stated

"""Byte deduplication against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tapelake.llm import byte_dedup


def brute(rows, window):
    """{(id, text): (n_bytes, n_removed, spans, kept digest)}; smaller ids and earlier starts come first, other rows of an id do not count."""
    rows = [(i, (t or "").encode()) for i, t in rows]
    smallest, own = {}, {}
    key = lambda i: 1 << 63 if i is None else i
    for i, t in rows:
        for s in range(len(t) - window + 1):
            w = t[s:s + window]
            smallest[w] = min(smallest.get(w, 1 << 63), key(i))
            own.setdefault((t, w), s)
    out = {}
    for i, t in rows:
        gone = np.zeros(len(t) + 1, np.int8)
        for s in range(len(t) - window + 1):
            w = t[s:s + window]
            if smallest[w] < key(i) or own[t, w] < s:
                gone[s:s + window] = 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone))))
        spans = [(int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2])]
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i, t] = (len(t), len(t) - len(kept), spans, kept)
    return out


def check(df, rows, window):
    want = brute(rows, window)
    got = byte_dedup.deduplicated(df, window=window, with_kept=True).collect()
    assert len(got) == len(rows)
    seen = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, [(s["first"], s["last"]) for s in r.spans], bytes(r.kept), r.kept_sha256) for r in got)
    assert seen == sorted((repr(i), *want[i, (t or "").encode()], hashlib.sha256(want[i, (t or "").encode()][3]).hexdigest()) for i, t in rows)
    return want


@pytest.fixture(scope="module")
def table():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé☃") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, line = [prose(30) for _ in range(4)], prose(9)
    rows = []
    for i in range(70):
        t = prose(rng.randrange(0, 60))
        for s in shared:
            if rng.random() < 0.3:
                a = rng.randrange(0, 40)
                t += s[a:rng.randrange(a, len(s) + 1)] + prose(rng.randrange(0, 3))
        rows.append((rng.choice([i, i, 7 * i % 31, None if i % 9 == 0 else i]), t + line * rng.randrange(0, 3)))
    return [*rows, *rows[:4], (500, "x" * 3000), (501, "y" + "x" * 500 + "z" * 40), (502, "ab" * 900), (503, prose(900) + shared[0]), (504, ""), (505, None),
            (None, None), (None, shared[0]), (506, shared[0] * 12), *[(600 + i, shared[1] + line) for i in range(40)], (-5, shared[1])]


@pytest.mark.parametrize("window", [32, 41, 100])
def test_windows_against_dictionary(spark, table, window):
    want = check(spark.createDataFrame(table, "doc_id long, text string").repartition(3), table, window)
    assert any(n for _, n, _, _ in want.values()) and any(0 < n < size for size, n, _, _ in want.values())


def test_slices_change_nothing(spark, table, monkeypatch):
    monkeypatch.setattr(byte_dedup, "_SLICE", 97)
    texts = [(t or "").encode() for _, t in table]
    whole = byte_dedup.Stretches(texts)
    covered = np.zeros(len(whole.data) + 1, int)
    for a, b in [*zip(whole.first, whole.last + 1), *zip(whole.again_first, whole.again_end)]:
        covered[a:b] += 1
    for s, t in zip(whole.bounds, texts):
        n = max(len(t) - 99, 0)
        assert (covered[s:s + n] == 1).all() and not covered[s + n:s + len(t)].any()
    which = np.arange(len(whole.first))
    of, place, key = whole.windows(which)
    names = {}
    for p, k in zip(place.tolist(), key.tolist()):
        assert names.setdefault(bytes(whole.data[p:p + 100]), k) == k
    assert len(set(names.values())) == len(names) and len(names) > 1000


def test_no_texts(spark):
    assert byte_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string, kept string")).collect() == []
    with pytest.raises(ValueError):
        byte_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string"), window=20)

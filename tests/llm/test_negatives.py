"""Hard negatives against all inner products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapelake.llm import hard_negatives as hard

ROWS = "vec_id long, embedding array<float>, label int, query string"


def brute(rows):
    """Result rows of (vec_id, components, label) rows, each vector's label moved on as the contract says."""
    rows = {(i, tuple(math.floor(256.0 * float(np.float32(x))) for x in v), (k + 1) % 10 if i % 7 == 0 else k) for i, v, k in rows
            if i is not None and v is not None and k is not None and all(x is not None and math.isfinite(np.float32(x)) for x in v)}
    out = []
    for a in rows:
        if a[0] % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], b[1])), b[0], b[2] == a[2]) for b in rows if b != a and len(b[1]) == len(a[1]))
        for p, positive, same in [s for s in scored if s[2]][:5]:
            good = [(-n, i) for n, i, s in scored if not s and 30 * -p <= 100 * -n <= 90 * -p][:10]
            out += [(a[0], positive, r + 1, i, -p, n) for r, (n, i) in enumerate(good)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard.mined(hard.relabelled(hard.prepared(df))).collect())


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.3], int(rng.integers(0, 10)), "clash") for i in range(900)]
    copies = [(1000 + i, rows[0][1], i % 3, None) for i in range(120)]
    odd = [(None, rows[0][1], 1, ""), (2000, None, 1, ""), (2100, rows[1][1], None, ""), (2200, [1.0, None], 1, ""), (2300, [float("nan")], 1, ""),
           (2400, [float("inf")], 1, ""), (2500, [], 1, ""), (2501, [], 1, ""), (2502, [], 2, ""), (2600, [0.5, 0.25], 3, ""), (2601, [0.5, 0.3], 3, ""),
           (2603, [0.3, 0.2], 4, ""), (100, rows[7][1], 5, ""), (2700, [0.0] * 8, 2, ""), (2800, [3.0e38] * 8, 2, "")]
    return [*rows, *copies, *odd[:-1], *rows[:30]]


def test_negatives_against_all_products(spark, table, monkeypatch):
    want = brute([r[:3] for r in table])
    assert mined(spark.createDataFrame(table, ROWS).repartition(5)) == want
    monkeypatch.setattr(hard, "ANCHORS", 4)
    monkeypatch.setattr(hard, "ZONES", 3)
    assert mined(spark.createDataFrame(table, ROWS)) == want
    assert any(i >= 1000 for _, _, _, i, _, _ in want) and {r[0] for r in want} > {0, 100, 2600}


def test_huge_components_and_no_rows(spark):
    rows = [(0, [3.0e38, 1.0], 1, ""), (1, [3.0e38, 1.0], 1, ""), (2, [1.0, -3.0e38], 2, "")]
    assert isinstance(mined(spark.createDataFrame(rows, ROWS)), list)
    assert mined(spark.createDataFrame([], ROWS)) == []


def test_zone_maps_leave_blocks_out(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 6))
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(size=6) * 0.05], i % 2, "") for i in range(4000)]
    ready = hard.prepared(spark.createDataFrame(rows, ROWS))
    blocks = hard.written_blocks(ready, 32)
    shapes = blocks.select("block", "label", "rows").collect()
    assert all(r.rows <= 32 for r in shapes) and sum(r.rows for r in shapes) == len(rows)
    queries = hard.anchors(blocks).withColumns({"lows": F.array(F.lit(-(1 << 62))), "highs": F.array(F.lit(1 << 62))})
    plan, _ = hard.block_plan(blocks, queries, 5, True)
    asked = sum(int.from_bytes(r.wanted, "big").bit_count() for r in plan.collect())
    assert queries.count() <= asked < 0.3 * queries.count() * len(shapes) / 2


def test_bounds_hold():
    rng = np.random.default_rng(9)
    vectors, rows = rng.integers(-300, 300, (20, 5)), rng.integers(-300, 300, (30, 5))
    least, greatest = hard.bounds(vectors, rows.min(axis=0)[None], rows.max(axis=0)[None])
    scores = vectors @ rows.T
    assert (least[:, 0] <= scores.min(axis=1)).all() and (scores.max(axis=1) <= greatest[:, 0]).all()


def test_curve_visits_neighbours():
    for dims in (2, 3):
        cells = np.array(np.meshgrid(*[np.arange(16)] * dims)).reshape(dims, -1).T
        path = cells[sorted(range(len(cells)), key=hard.hilbert_keys(cells).__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()

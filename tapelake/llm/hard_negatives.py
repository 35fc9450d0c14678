"""Hard negatives by inner product, over Hilbert-ordered blocks with zone maps.

Vectors become integers (floor(256 x) of every component). Candidates are sorted by label and by their place on a Hilbert curve
through their leading components and written as blocks of at most ``BLOCK`` rows of one label and one length, one Parquet row a
block: numbers and vectors packed, and beside them the zone map, every dimension's smallest and largest value. Zone maps are
read without the vectors. By interval arithmetic a map gives the least and the greatest score an anchor can have in a block. A
block is read for an anchor if that range meets one of its windows of scores, unless blocks that lie wholly inside the window
hold enough rows with better scores already. Only blocks that some anchor needs are read, and scored for those anchors alone.

Positives are the best rows of the anchor's label, negatives the best of the other labels within the window that each positive
opens; both are one search. Anchors are a stated query set: stripes of them meet stripes of the zone maps in a grid, and both the
stripes and what is read for a cell are bounded, so a cell's memory is, whatever the number of rows. Copies of one vector spread
over blocks like any others, and their zone maps are exact.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths have no
score with each other. Repeated rows (id, label and vector equal) are one; rows of one id that differ are different rows. Ties go
by id, then by label and place on the curve. Scores are exact: products that doubles cannot hold are formed in 64-bit integers. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapelake.llm.store import stored

SCALE, LABELS = 256, 10
BLOCK = 256
#: Rows of the anchor stripes and blocks of the zone-map stripes of a cell, at most about.
ANCHORS, ZONES = 1024, 256
#: Bits of a component and bytes of the curve that order the rows.
_BITS, _CURVE = 4, 32
_MOST = 1 << 52
_TYPES = (np.int16, np.int32, np.int64)


def prepared(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part, with integer components."""
    out = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    out = out.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # Doubles beyond 2**52 have no fraction; what a long cannot hold becomes its nearest.
    return out.withColumn("vector", F.transform("vector", lambda x: F.floor(
        F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(_MOST))), F.lit(float(-_MOST)))).cast("long")))


def relabelled(rows: DataFrame) -> DataFrame:
    """Prepared rows with the label of every seventh id moved on by one."""
    return rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))


def hilbert_keys(cells: np.ndarray, bits: int = _BITS) -> list[bytes]:
    """Places on the Hilbert curve of points with whole coordinates below 2**bits, one row a point."""
    n, dims = cells.shape
    if not dims:
        return [b""] * n
    x = cells.T.astype(np.uint8).copy()
    bit = 1 << (bits - 1)
    while bit > 1:  # undo the turns of the curve, from the largest cells on
        low = np.uint8(bit - 1)
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint8)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(n, np.uint8)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[dims - 1] & bit, np.uint8(bit - 1), np.uint8(0))
        bit >>= 1
    x ^= turn
    planes = [(x >> np.uint8(b)) & np.uint8(1) for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).T, axis=1)
    return [p.tobytes() for p in packed]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as they need, the first byte saying how many."""
    kind = next(t for t in _TYPES if not values.size or (np.iinfo(t).min <= values.min() and values.max() <= np.iinfo(t).max))
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _unpacked(data: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[0]}", offset=1).reshape(rows, width)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    most = lambda m: int(np.abs(m.astype(np.float64)).max()) if m.size else 0
    if most(a) * most(b) * max(a.shape[1], 1) < _MOST:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


_BLOCKS = "block bigint, label bigint, width int, rows int, ids binary, vectors binary, low binary, high binary"
_BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("rows", pa.int32()), ("ids", pa.binary()),
                           ("vectors", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def written_blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The stored blocks of prepared rows; ``size`` is at most ``BLOCK``."""
    top = rows.agg(F.max(F.greatest(F.array_max("vector"), -F.array_min("vector")))).first()[0] or 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.array([len(v) for v in batch.column(2).to_pylist()], np.int32) if batch.num_rows else np.zeros(0, np.int32)
            keys: list[bytes] = [b""] * batch.num_rows
            for width in np.unique(widths):
                own = np.flatnonzero(widths == width)
                vectors = batch.column(2).take(pa.array(own)).flatten().to_numpy().reshape(len(own), width)[:, :8 * _CURVE // _BITS]
                cells = np.clip((vectors / top + 1) * (1 << (_BITS - 1)), 0, (1 << _BITS) - 1)
                for i, key in zip(own, hilbert_keys(cells)):
                    keys[i] = key
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(widths, pa.int32()), pa.array(keys, pa.binary())],
                                             names=["id", "label", "vector", "width", "key"])

    order = ["width", "label", "key", "id", "vector"]
    keyed = rows.select("id", "label", "vector").mapInArrow(place, "id bigint, label bigint, vector array<bigint>, width int, key binary")
    ordered = keyed.repartitionByRange(*order[:-1]).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kind, held, last = None, [], None
        for batch in batches:
            for ident, label, vector, width in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "vector", "width"))):
                if held and ((width, label) != kind or len(held) == size):
                    yield block(number, kind, held)
                    number, held = number + 1, []
                if (width, label, ident, vector) == last:
                    continue
                kind, last = (width, label), (width, label, ident, vector)
                held.append((ident, vector))
        if held:
            yield block(number, kind, held)

    def block(number: int, kind: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
        width, label = kind
        ids = np.array([i for i, _ in held], np.int64)
        vectors = np.array([v for _, v in held], np.int64).reshape(len(held), width)
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        row = (number, label, width, len(held), ids.tobytes(), _packed(vectors), _packed(low), _packed(high))
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK_SCHEMA)], schema=_BLOCK_SCHEMA)

    return stored(ordered.select("id", "label", "vector", "width").mapInArrow(cut, _BLOCKS), "negative-blocks")


_QUERIES = "query bigint, id bigint, label bigint, width int, vector binary"


def anchors(blocks: DataFrame, every: int = 100) -> DataFrame:
    """Rows of the blocks whose id ``every`` divides; ``query`` is their place: block and row."""
    schema = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("width", pa.int32()), ("vector", pa.binary())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for number, label, width, ids, vectors in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, np.int64)
                matrix = _unpacked(vectors, len(ids), width)
                for i in np.flatnonzero(ids % every == 0):
                    for column, value in zip(out, (number * BLOCK + int(i), int(ids[i]), label, width, _packed(matrix[i]))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return blocks.select("block", "label", "width", "ids", "vectors").mapInArrow(pick, _QUERIES)


def _matrices(table: pa.Table, width: int, *columns: str) -> list[np.ndarray]:
    """Packed vectors of one length, a row each."""
    return [np.array([_unpacked(x, 1, width)[0] for x in table[c].to_pylist()], np.int64).reshape(table.num_rows, width) for c in columns]


def _windows(queries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of each query's windows; missing ones are empty."""
    lows, highs = queries["lows"].to_pylist(), queries["highs"].to_pylist()
    most = max(map(len, lows), default=0)
    low, high = np.ones((len(lows), most), np.int64), np.zeros((len(lows), most), np.int64)
    for i, (a, b) in enumerate(zip(lows, highs)):
        low[i, :len(a)], high[i, :len(b)] = a, b
    return low, high


def bounds(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner products of each vector with any vector between ``low`` and ``high``."""
    up, down = np.maximum(vectors, 0), np.minimum(vectors, 0)
    return _products(up, low) + _products(down, high), _products(up, high) + _products(down, low)


def needed(least: np.ndarray, greatest: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Which blocks each query must read for the best ``k`` rows of its window, from the bounds of their scores.

    ``rows`` are a block's rows that count for a query, 0 where it cannot be asked at all.
    """
    meets = (rows > 0) & (greatest >= low[:, None]) & (least <= high[:, None])
    inside = meets & (least >= low[:, None]) & (greatest <= high[:, None])
    order = np.argsort(np.where(inside, -least, _MOST << 10), axis=1, kind="stable")
    enough = np.cumsum(np.take_along_axis(np.where(inside, rows, 0), order, 1), 1) >= k
    at = np.take_along_axis(order, enough.argmax(1)[:, None], 1)
    floor = np.where(enough.any(1), np.take_along_axis(least, at, 1)[:, 0], low)
    return meets & (greatest >= floor[:, None])


_PLAN = "a int, z int, block bigint, wanted binary"
_FOUND = "query bigint, nr int, score bigint, id bigint, place bigint"
_FOUND_SCHEMA = pa.schema([("query", pa.int64()), ("nr", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])


def _grid(blocks: DataFrame, queries: DataFrame) -> tuple[Column, Column, int, int]:
    """Columns that deal queries and blocks into stripes, and how many of each there are."""
    n, m = blocks.count(), queries.count()
    a = -(-m // ANCHORS) or 1
    spread = -(-blocks.sparkSession.sparkContext.defaultParallelism // a)
    z = max(-(-n // ZONES), min(n, spread), 1)
    return F.pmod(F.xxhash64("query"), F.lit(a)).cast("int"), F.pmod(F.xxhash64("block"), F.lit(z)).cast("int"), a, z


def block_plan(blocks: DataFrame, queries: DataFrame, k: int, same_label: bool) -> tuple[DataFrame, DataFrame]:
    """What to read: (a, z, block, wanted) rows, ``wanted`` with a bit for each query of stripe a; and the queries of the cells."""
    stripe, zone, a, z = _grid(blocks, queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = queries.withColumn("a", stripe).withColumn("z", every(z))
    maps = blocks.select("block", "label", "width", "rows", "low", "high").withColumn("z", zone).withColumn("a", every(a))

    def choose(key: tuple, maps: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("query")
        numbers, chosen, wanted = asked["query"].to_numpy(), [], []
        labels, widths = asked["label"].to_numpy(), asked["width"].to_numpy()
        low, high = _windows(asked)
        for width in np.intersect1d(widths, maps["width"].to_numpy()):
            own = np.flatnonzero(widths == width)
            some = maps.filter(pa.array(maps["width"].to_numpy() == width))
            least, greatest = bounds(_matrices(asked.take(own), int(width), "vector")[0], *_matrices(some, int(width), "low", "high"))
            block = some["block"].to_numpy()
            rows = np.where((labels[own][:, None] == some["label"].to_numpy()) == same_label, some["rows"].to_numpy(), 0)
            rows = rows - ((numbers[own] // BLOCK)[:, None] == block) * (rows > 0)
            need = np.zeros((len(asked), len(block)), bool)
            for j in range(low.shape[1]):
                need[own] |= needed(least, greatest, rows, low[own, j], high[own, j], k)
            for i in np.flatnonzero(need.any(axis=0)):
                chosen.append(int(block[i]))
                wanted.append(np.packbits(need[:, i]).tobytes())
        n = len(chosen)
        return pa.table([pa.array([key[0].as_py()] * n, pa.int32()), pa.array([key[1].as_py()] * n, pa.int32()), pa.array(chosen, pa.int64()),
                         pa.array(wanted, pa.binary())], names=["a", "z", "block", "wanted"])

    return maps.groupBy("a", "z").cogroup(cells.groupBy("a", "z")).applyInArrow(choose, _PLAN), cells


def _best(found: list[np.ndarray], k: int) -> np.ndarray:
    """The first ``k`` of each query and window, rows of (query, nr, score, id, place)."""
    rows = np.concatenate(found, axis=1) if found else np.zeros((5, 0), np.int64)
    rows = rows[:, np.lexsort((rows[4], rows[3], -rows[2], rows[1], rows[0]))]
    new = np.ones(rows.shape[1], bool)
    new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
    start = np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))
    return rows[:, np.arange(rows.shape[1]) - start < k]


def search(blocks: DataFrame, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The first ``k`` rows in each window of each query: query, nr of the window, rank (from 1), id, score.

    Queries have query, id, label, width, vector, and the bounds of their windows in lows and highs.
    """
    plan, cells = block_plan(blocks, queries, k, same_label)
    read = plan.join(blocks.select("block", "rows", "width", "ids", "vectors"), "block")

    def score(key: tuple, read: pa.Table, asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("query")
        numbers, widths = asked["query"].to_numpy(), asked["width"].to_numpy()
        low, high = _windows(asked)
        matrix = {int(w): _matrices(asked.filter(pa.array(widths == w)), int(w), "vector")[0] for w in np.unique(widths)}
        at = {w: np.cumsum(widths == w) - 1 for w in matrix}
        found: list[np.ndarray] = []
        held = 0
        for block, wanted, rows, width, ids, vectors in zip(*(read[c].to_pylist() for c in ("block", "wanted", "rows", "width", "ids", "vectors"))):
            own = np.flatnonzero(np.unpackbits(np.frombuffer(wanted, np.uint8), count=len(numbers)))
            ids = np.frombuffer(ids, np.int64)
            by_id = np.argsort(ids, kind="stable")
            scores = _products(matrix[width][at[width][own]], _unpacked(vectors, rows, width))[:, by_id]
            order = np.argsort(-scores, axis=1, kind="stable")
            ranked, places = np.take_along_axis(scores, order, 1), block * BLOCK + by_id[order]
            for j in range(low.shape[1]):
                # The anchor itself may stand among the first.
                first = (ranked > high[own, j][:, None]).sum(axis=1)
                cols = first[:, None] + np.arange(k + 1)
                inside = np.minimum(cols, rows - 1)
                score, place = np.take_along_axis(ranked, inside, 1), np.take_along_axis(places, inside, 1)
                keep = (cols < rows) & (score >= low[own, j][:, None]) & (place != numbers[own][:, None])
                q, c = np.nonzero(keep)
                found.append(np.stack([numbers[own][q], np.full(len(q), j), score[q, c], ids[place[q, c] - block * BLOCK], place[q, c]]))
                held += len(q)
            if held > 1 << 20:
                found = [_best(found, k)]
                held = found[0].shape[1]
        return pa.table([pa.array(c, f.type) for c, f in zip(_best(found, k), _FOUND_SCHEMA)], schema=_FOUND_SCHEMA)

    found = read.groupBy("a", "z").cogroup(cells.groupBy("a", "z")).applyInArrow(score, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query", "nr").orderBy(F.col("score").desc(), "id", "place"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "nr", "rank", "id", "score")


def mined(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Prepared rows' hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides, a positive is one of the best rows of the anchor's label, and its negatives
    are the best rows of other labels that score from 30 to 90 percent of it; a positive below zero has none.
    """
    blocks = written_blocks(rows)
    queries = stored(anchors(blocks, every), "negative-anchors")
    whole = queries.withColumns({"lows": F.array(F.lit(-(1 << 62))), "highs": F.array(F.lit(1 << 62))})
    best = stored(search(blocks, whole, positives, True), "negative-positives")
    share = lambda tenths: F.col("score").cast("decimal(20,0)") * tenths / 10
    windows = best.select("query", "rank", F.ceil(share(3)).cast("long").alias("low"), F.floor(share(9)).cast("long").alias("high"))
    windows = windows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("w"))
    asked = stored(queries.join(windows, "query").select(*queries.columns, F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "negative-windows")
    found = search(blocks, asked, negatives, False)
    of = best.select("query", (F.col("rank") - 1).alias("nr"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(of, ["query", "nr"]).join(queries.select("query", F.col("id").alias("anchor_id")), "query")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
                      F.col("score").alias("negative_score"))

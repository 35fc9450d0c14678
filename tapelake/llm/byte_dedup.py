"""Removal of repeated byte strings by bucket-pointer refinement, as in the building of suffix arrays.

Equal strings are suffixes that share a bucket at their depth. A bucket identifier of depth 2d comes from those of depth d at a
place and d later, from single bytes up to q-grams of ``GRAM`` bytes: the initial buckets. Every window of ``WINDOW`` bytes has
one place, its pointer, where the smallest q-gram identifier stands (the first of equal ones); windows that follow each other
with one pointer form its stretch. Equal windows have equal pointers, so only buckets of pointers are sorted, not of all places.

Round one sorts pointers by their bucket, and sub-buckets, which the identifiers of the later offsets that make up the whole
stretch refine: equal stretches. It tells who is first in a sub-bucket and whether a bucket has several. Round two refines what is
still open, the first stretches of buckets with several sub-buckets: their windows are sorted by the identifiers of the offsets
that make up a window. All others are settled by round one: a stretch with an earlier copy goes whole, and is represented by it.

Texts are dealt into chunks by a hash; a chunk sends its distinct buckets and sub-buckets to ranges of identifiers, packed, a
bucket with a mark of its stretch (or that it has several), a sub-bucket with the smallest document id, and is told what holds over
all chunks (see ``chunks``). So neither copies by the thousand, nor a passage that every document has, nor a q-gram in ever new
surroundings makes more than one entry a chunk in any range. Chunks and ranges number about the square root of the corpus in units
of some kilobytes; a longer text is worked through in slices. Sub-buckets and windows are told apart by 64 bits, buckets by 48 and
those of their range, marks by 40.

Null texts are empty. A null id counts as larger than any other. Rows with the same id do not remove from each other, so
repeated rows are judged alike. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.chunks import chunk_count, expanded, offsets48, range_cuts, squeezed, unpacked48
from tapelake.llm.substring_dedup import merged
from tapelake.llm.words import mixed

WINDOW, GRAM = 100, 32
_SLICE = 1 << 20
_LOW = np.uint64((1 << 21) - 1)
_NO_ID = (1 << 63) - 1
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
_STEP, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_STRETCH = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a stretch's identifier that tell whether a bucket has several.
_MARK = np.uint64((1 << 40) - 1)


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Identifiers of the ``GRAM`` bytes from every place on (fewer places than bytes), by doubling their depth."""
    out, depth, factor = _BYTES[data], 1, _STEP
    while depth < GRAM:
        out = out[:-depth] * np.uint64(factor) + out[depth:]
        factor = factor * factor & _MASK
        depth *= 2
    return mixed(out)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:len(values) - (width - span)], values[width - span:]) if span < width else values


def _refined(grams: np.ndarray, offsets: list[np.ndarray]) -> np.ndarray:
    """Identifiers of longer strings from those of the q-grams at later offsets that cover them."""
    out = grams[offsets[0]] * _STRETCH
    for at in offsets[1:]:
        out = mixed(out + grams[at]) * _STRETCH
    return mixed(out)


class Stretches:
    """Stretches of windows with one pointer, of some texts joined to one run of bytes.

    ``first`` and ``last`` are the places where a stretch's windows begin, ``bucket`` and ``own`` the identifiers of its pointer
    and of the whole stretch, ``text`` the number of its text. ``windows`` gives identifiers of windows.
    """

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.window = window
        # A byte between two texts keeps what is removed at the end of one apart from the start of the next.
        self.data = np.frombuffer(b"".join([t + b"\0" for t in texts]), np.uint8)
        self.bounds = np.concatenate((np.zeros(1, np.int64), np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
        found = [self._slice(a, min(a + _SLICE, len(self.data) - window + 1)) for a in range(0, len(self.data) - window + 1, _SLICE)]
        whole = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
        self.again_first, self.again_end, self.first, self.last, self.bucket, self.own = whole
        self.text = np.searchsorted(self.bounds, self.first, "right") - 1

    def _slice(self, start: int, stop: int) -> tuple[np.ndarray, ...]:
        """Stretches of the windows that begin from ``start`` to ``stop``."""
        grams = gram_buckets(self.data[start:stop + self.window - 1])
        n, width = stop - start, self.window - GRAM + 1
        # The upper bits of an identifier and the place: the smallest is the pointer, the first of equal ones.
        marked = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        pointer = (_sliding_least(marked, width) & _LOW).astype(np.int64)
        new = np.ones(n, bool)
        new[1:] = pointer[1:] != pointer[:-1]
        inside = np.ones(n, bool)
        near = slice(*np.searchsorted(self.bounds, [start, stop - 1], "right") + [0, 1])
        for border in self.bounds[near].tolist():  # windows across the border of two texts
            a, b = max(border - self.window - start, 0), border - start
            inside[a:max(min(b, n), 0)] = False
            if b < n:
                new[b] = True
        first = np.flatnonzero(new & inside)
        # A stretch ends where the next begins, or where windows cross a border.
        stop_at = np.flatnonzero(np.concatenate((new[1:] | ~inside[1:], [True])) & inside)
        last = stop_at[np.searchsorted(stop_at, first)]
        at, final = pointer[first], last + self.window - GRAM
        own = _refined(grams, [*(np.minimum(first + GRAM * j, final) for j in range(-(-(self.window + width - 1) // GRAM))), final])
        own = mixed(own + ((at - first).astype(np.uint64) << np.uint64(32)) + (last - first).astype(np.uint64))
        # Spread again: the smallest of many identifiers are small ones.
        bucket, text = mixed(grams[at] ^ _STRETCH), np.searchsorted(self.bounds, first + start, "right")
        same = np.zeros(len(first), bool)
        same[1:] = (bucket[1:] == bucket[:-1]) & (own[1:] == own[:-1]) & (text[1:] == text[:-1])
        again = merged(first[same] + start, last[same] + start + 1)
        return *again, first[~same] + start, last[~same] + start, bucket[~same], own[~same]

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some stretches in order all windows: number of the stretch, place, identifier."""
        n = self.last[which] - self.first[which] + 1
        of = np.repeat(which, n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.first[of]
        out = np.zeros(len(of), np.uint64)
        offsets = [*range(0, self.window - GRAM, GRAM), self.window - GRAM]
        cuts = [0, *(np.flatnonzero(np.diff(place // _SLICE)) + 1).tolist(), len(place)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                start = int(place[a])
                grams = gram_buckets(self.data[start:int(place[b - 1]) + self.window])
                out[a:b] = _refined(grams, [place[a:b] - start + o for o in offsets])
        return of, place, out


def _first_rows(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which rows begin a run of equal keys, in an order."""
    new = np.ones(len(order), bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    return new


def _again(new: np.ndarray, group: np.ndarray, text: np.ndarray, ids: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of rows sorted by sub-bucket and place, those that stand earlier in their own text or in one with a smaller id."""
    again = least[group] < ids[text]
    again[1:] |= ~new[1:] & (text[1:] == text[:-1])
    return again


class _Chunk:
    """A chunk's texts in a fixed order, and what round one asks for."""

    def __init__(self, docs: pa.Table, window: int):
        ids = np.array([_NO_ID if i is None else i for i in docs["doc_id"].to_pylist()], np.int64)
        texts = [(t or "").encode() for t in docs["text"].to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.order, self.ids, self.texts = order, ids[order], [texts[i] for i in order]
        self.found = Stretches(self.texts, window)
        f = self.found
        # Sub-buckets by name, within each by place: texts stand in the order of their ids.
        name = mixed(f.bucket * _STRETCH + f.own)
        self.sorted = np.lexsort((f.first, name))
        self.new = _first_rows(self.sorted, name)
        self.group = np.cumsum(self.new) - 1
        head = self.sorted[self.new]
        self.names, self.least = name[head], self.ids[f.text[head]]
        # Of every bucket a mark of its stretch; none if there are several here already.
        self.buckets, self.bucket_of = np.unique(f.bucket, return_inverse=True)
        order = np.lexsort((f.own, f.bucket))
        starts = np.flatnonzero(_first_rows(order, f.bucket))
        low = f.own[order][starts]
        high = f.own[order][np.concatenate((starts[1:] - 1, [len(order) - 1]))] if len(order) else low
        self.marks = np.where(low == high, (low & _MARK) | np.uint64(1), np.uint64(0))

    def repeated(self, least: np.ndarray) -> np.ndarray:
        """Stretches with an earlier copy, in the order ``sorted``: in a smaller document, or earlier in their own."""
        return _again(self.new, self.group, self.found.text[self.sorted], self.ids, np.minimum(least, self.least))


class _Open:
    """The windows that round two asks for: those of unsettled stretches in buckets of several sub-buckets."""

    def __init__(self, chunk: _Chunk, least: np.ndarray, several: np.ndarray):
        again = chunk.repeated(least)
        which = np.sort(chunk.sorted[~again & several[chunk.bucket_of[chunk.sorted]]])
        self.of, self.place, self.key = chunk.found.windows(which)
        self.text = chunk.found.text[self.of]
        self.sorted = np.lexsort((self.place, self.key))
        self.new = _first_rows(self.sorted, self.key)
        self.group = np.cumsum(self.new) - 1
        head = self.sorted[self.new]
        self.keys, self.least = self.key[head], chunk.ids[self.text[head]]
        self.gone = chunk.sorted[again]

    def repeated(self, ids: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of windows with an earlier copy."""
        again = _again(self.new, self.group, self.text[self.sorted], ids, np.minimum(least, self.least))
        return self.place[self.sorted[again]]


_ASKED = "range int, chunk int, keys binary, marks binary, ids binary"
_TOLD = "chunk int, range int, ids binary, several binary"


def _table(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _asked(chunk: int, count: int, keys: np.ndarray, marks: np.ndarray | None = None, ids: np.ndarray | None = None) -> list[tuple]:
    """Requests of sorted keys, a row for each range that has any: buckets with marks, or sub-buckets with ids."""
    cuts, rows = range_cuts(keys, count), []
    for i in range(count):
        a, b = int(cuts[i]), int(cuts[i + 1])
        if a < b and marks is not None:
            rows.append((i, chunk, offsets48(keys[a:b], i, count), squeezed(marks[a:b]), None))
        elif a < b:
            rows.append((i, chunk, squeezed(np.diff(keys[a:b], prepend=np.uint64(0))), None, squeezed(ids[a:b])))
    return rows


def _ask_table(rows: list[tuple]) -> pa.Table:
    return _table(rows, [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["range", "chunk", "keys", "marks", "ids"])


def _told(key: tuple, asked: pa.Table) -> pa.Table:
    """What a range answers, in the order of each request: whether a bucket has several stretches, the smallest id of a sub-bucket."""
    rows, by_mark = [], pa.compute.is_valid(asked["marks"])
    for part, answer, values in ((asked.filter(by_mark), _several, "marks"), (asked.filter(pa.compute.invert(by_mark)), _least, "ids")):
        if not part.num_rows:
            continue
        marked = values == "marks"
        keys = [unpacked48(k) if marked else np.cumsum(expanded(k, np.uint64), dtype=np.uint64) for k in part["keys"].to_pylist()]
        cuts = np.cumsum([0, *map(len, keys)])
        told = answer(np.concatenate(keys), np.concatenate([expanded(x, np.uint64 if marked else np.int64) for x in part[values].to_pylist()]))
        for chunk, a, b in zip(part["chunk"].to_pylist(), cuts[:-1], cuts[1:]):
            packed = squeezed(told[a:b])
            rows.append((chunk, key[0].as_py(), None if marked else packed, packed if marked else None))
    return _table(rows, [pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["chunk", "range", "ids", "several"])


def _several(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    order = np.lexsort((marks, keys))
    starts = np.flatnonzero(_first_rows(order, keys))
    low, high = marks[order][starts], marks[order][np.concatenate((starts[1:] - 1, [len(order) - 1]))]
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(((low != high) | (low == 0)).astype(np.uint8), np.diff(np.concatenate((starts, [len(order)]))))
    return out


def _least(keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    order = np.lexsort((ids, keys))
    new = _first_rows(order, keys)
    out = np.empty(len(ids), np.int64)
    out[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    # What is not smaller than the asker's own id tells it nothing.
    return np.where(out < ids, out, _NO_ID)


def _answers(told: pa.Table, column: str, dtype: type) -> np.ndarray:
    rows = told.filter(pa.compute.is_valid(told[column])).sort_by("range")
    return np.concatenate([np.zeros(0, dtype), *(expanded(x, dtype) for x in rows[column].to_pylist())])


def _open(chunk: _Chunk, told: pa.Table) -> _Open:
    return _Open(chunk, _answers(told, "ids", np.int64), _answers(told, "several", np.uint8).astype(bool))


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<first:bigint,last:bigint>>, kept binary, kept_sha256 string"
_SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_kept: bool = False) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (the bytes left, or null), kept_sha256.

    A byte goes if a string of ``window`` bytes around it also starts earlier: in a document with a smaller id, or before in its
    own. ``window`` is at least ``GRAM`` bytes.
    """
    if not GRAM <= window <= 4 * GRAM:
        raise ValueError(f"window must be from {GRAM} to {4 * GRAM}")
    count = chunk_count(docs, text)
    rows = docs.select(F.pmod(F.xxhash64(doc_id, text), F.lit(count)).cast("int").alias("chunk"), F.col(doc_id).cast("long").alias("doc_id"),
                       F.col(text).alias("text")).groupBy("chunk")

    def ask(key: tuple, docs: pa.Table) -> pa.Table:
        chunk = _Chunk(docs, window)
        at = key[0].as_py()
        return _ask_table(_asked(at, count, chunk.buckets, marks=chunk.marks) + _asked(at, count, chunk.names, ids=chunk.least))

    def refine(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        still = _open(_Chunk(docs, window), told)
        return _ask_table(_asked(key[0].as_py(), count, still.keys, ids=still.least))

    def cut(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        second = pa.compute.equal(told["round"], 2)
        chunk = _Chunk(docs, window)
        still = _open(chunk, told.filter(pa.compute.invert(second)))
        windows = still.repeated(chunk.ids, _answers(told.filter(second), "ids", np.int64))
        found = chunk.found
        starts = np.concatenate((found.first[still.gone], found.again_first, windows))
        ends = np.concatenate((found.last[still.gone] + 1, found.again_end, windows + 1)) + window - 1
        starts, ends = merged(starts, ends)
        of = np.searchsorted(found.bounds, starts, "right") - 1
        out: list[tuple] = []
        cuts = np.searchsorted(of, np.arange(len(chunk.texts) + 1))
        for i, whole in enumerate(chunk.texts):
            spans = [(int(s - found.bounds[i]), int(e - found.bounds[i])) for s, e in zip(starts[cuts[i]:cuts[i + 1]], ends[cuts[i]:cuts[i + 1]])]
            kept = whole
            if spans:
                edges = [0, *(x for s in spans for x in s), len(whole)]
                kept = b"".join(whole[a:b] for a, b in zip(edges[0::2], edges[1::2]))
            out.append((docs["doc_id"][chunk.order[i]].as_py(), len(whole), len(whole) - len(kept), [{"first": a, "last": b} for a, b in spans],
                        kept if with_kept else None, hashlib.sha256(kept).hexdigest()))
        return _table(out, [pa.int64(), pa.int64(), pa.int64(), _SPAN, pa.binary(), pa.string()],
                      ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"])

    first = rows.applyInArrow(ask, _ASKED).groupBy("range").applyInArrow(_told, _TOLD)
    second = rows.cogroup(first.groupBy("chunk")).applyInArrow(refine, _ASKED).groupBy("range").applyInArrow(_told, _TOLD)
    told = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return rows.cogroup(told.groupBy("chunk")).applyInArrow(cut, _RESULT)

"""Benchmark decontamination with a distributed positional inverted index.

Documents are cut into segments of some megabytes. A segment's postings (every word's places, words by hash) are written to
the shared folder as one row, so the index is a table spread over files that later searches read again. Test windows are
packed in blocks, and every block meets every segment: a window's lists are intersected from its rarest word in the segment
on, each list moved by the word's offset, until the last word has confirmed or the window has died out. Places leave gaps
between documents, so no match crosses a border. ``slop`` allows each word to stand that many places off: proximity matches.

Null texts have no words; items without words are not searched for, items without id are, but are named nowhere; repeated rows are judged row by row,
repeated item ids are one item; an empty table of either kind gives no matches; further columns are ignored; a text longer
than a segment is a segment of its own. Equality of words is that of 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.llm.store import numbered, stored
from tapelake.llm.words import ALNUM, Words, as_bytes, text_slices

#: Places between two documents of a segment; no slop may reach across.
GAP = 64
_SEGMENT_BYTES = 1 << 22
_BLOCK_WINDOWS = 1 << 15
_INDEX = "segment string, ids array<bigint>, n_words array<bigint>, terms binary, counts binary, places binary"
_BLOCK = "items array<string>, lengths binary, terms binary"
_MATCH = "segment string, nr int, item_id string, first bigint, last bigint"


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def write_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = _SEGMENT_BYTES) -> DataFrame:
    """The stored index of all documents: one row a segment."""
    schema = pa.schema([("segment", pa.string()), ("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())),
                        ("terms", pa.binary()), ("counts", pa.binary()), ("places", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), as_bytes(batch.column(1))
            for a, b in text_slices(texts, segment_bytes):
                words = Words(texts[a:b], ALNUM, lower=True)
                n_words = np.diff(words.bounds)
                places = np.arange(len(words.hashes)) + np.repeat(np.arange(b - a) * GAP, n_words)
                order = np.argsort(words.hashes, kind="stable")
                terms, counts = np.unique(words.hashes[order], return_counts=True)
                yield _batch(schema, [[uuid.uuid4().hex], [ids.slice(a, b - a).to_pylist()], [n_words.tolist()], [terms.tobytes()],
                                      [counts.astype(np.uint32).tobytes()], [places[order].astype(np.uint32).tobytes()]])

    return stored(docs.select(F.col(doc_id).cast("long"), text).mapInArrow(build, _INDEX), "phrase-index")


def window_blocks(items: DataFrame, length: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """All windows of ``length`` consecutive words of the items, a shorter item being one window, packed in blocks."""
    schema = pa.schema([("items", pa.list_(pa.string())), ("lengths", pa.binary()), ("terms", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            held: list[tuple[str | None, np.ndarray]] = []
            for a, b in text_slices(texts):
                words = Words(texts[a:b], ALNUM, lower=True)
                for i in range(a, b):
                    own = words.hashes[words.bounds[i - a]:words.bounds[i - a + 1]]
                    for s in range(max(len(own) - length, 0) + 1 if len(own) else 0):
                        held.append((names[i], own[s:s + length]))
                        if len(held) == _BLOCK_WINDOWS:
                            yield block(held)
                            held = []
            if held:
                yield block(held)

    def block(held: list[tuple[str | None, np.ndarray]]) -> pa.RecordBatch:
        lengths = np.array([len(w) for _, w in held], np.uint32)
        return _batch(schema, [[[n for n, _ in held]], [lengths.tobytes()], [np.concatenate([w for _, w in held]).tobytes()]])

    return stored(items.select(F.col(item_id).cast("string"), text).mapInArrow(pack, _BLOCK), "phrase-windows")


class _Segment:
    """Posting lists of one segment: (term number, place) pairs in order, as one sorted array of 64-bit keys."""

    def __init__(self, terms: bytes, counts: bytes, places: bytes):
        self.terms, self.counts = np.frombuffer(terms, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)
        self.starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.counts)))
        self.places = np.frombuffer(places, np.uint32).astype(np.int64)
        self.keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) << 32, self.counts) + self.places

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 where the segment lacks the term."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term's list has an entry at most ``slop`` from the place."""
        low = (term << 32) + np.maximum(place - slop, 0)
        at = np.minimum(np.searchsorted(self.keys, low), len(self.keys) - 1)
        found = self.keys[at]
        return (found >= low) & (found <= (term << 32) + place + slop) & (place + slop >= 0)

    def matches(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows (rows of term numbers) and the places where they begin."""
        alive = np.flatnonzero((terms >= 0).all(axis=1))
        terms = terms[alive]
        rarest = np.argsort(self.counts[terms], axis=1, kind="stable")
        first = rarest[:, 0]
        lead = terms[np.arange(len(terms)), first]
        n = self.counts[lead]
        window = np.repeat(np.arange(len(terms)), n)
        within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        start = self.places[self.starts[lead][window] + within] - first[window]
        for j in range(1, terms.shape[1]):
            offset = rarest[window, j]
            held = self.near(terms[window, offset], start + offset, slop)
            window, start = window[held], start[held]
        return alive[window], start


def phrase_matches(index: DataFrame, blocks: DataFrame, slop: int = 0) -> DataFrame:
    """Where items occur: (segment, nr of the document there, item_id, first, last), word numbers, ``last`` exclusive.

    Windows of one item that follow each other come as one row.
    """
    if not 0 <= slop < GAP:
        raise ValueError(f"slop must be from 0 to {GAP - 1}")
    schema = pa.schema([("segment", pa.string()), ("nr", pa.int32()), ("item_id", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                segment = _Segment(row["terms"], row["counts"], row["places"])
                if not len(segment.terms):
                    continue
                lengths = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
                ends = np.cumsum(lengths)
                numbers = segment.numbers(np.frombuffer(row["window_terms"], np.uint64))
                numbered_items = {name: i for i, name in enumerate(dict.fromkeys(row["items"]))}
                item_names = np.array(list(numbered_items), object)
                item_of = np.array([numbered_items[name] for name in row["items"]], np.int64)
                found = []
                for k in np.unique(lengths):
                    own = np.flatnonzero(lengths == k)
                    window, start = segment.matches(numbers[(ends[own] - k)[:, None] + np.arange(k)], slop)
                    found.append(np.stack([item_of[own[window]], start, start + k], axis=1))
                hits = np.concatenate(found)
                hits = hits[np.lexsort((hits[:, 2], hits[:, 1], hits[:, 0]))]
                n_words = np.array(row["n_words"], np.int64)
                begins = np.concatenate((np.zeros(1, np.int64), np.cumsum(n_words + GAP)))
                nr = np.searchsorted(begins, np.maximum(hits[:, 1], 0), "right") - 1
                first = np.maximum(hits[:, 1] - begins[nr], 0)
                last = np.minimum(hits[:, 2] - begins[nr], n_words[nr])
                # A run goes on while item and document stay and the next window touches what is covered.
                new = np.ones(len(hits), bool)
                new[1:] = (hits[1:, 0] != hits[:-1, 0]) | (nr[1:] != nr[:-1]) | (first[1:] > last[:-1])
                at = np.flatnonzero(new)
                if len(at):
                    yield _batch(schema, [[row["segment"]] * len(at), nr[at], item_names[hits[at, 0]], first[at],
                                          np.maximum.reduceat(last, at)])

    # The test windows are a stated query set: each block goes to every segment, whatever the number of blocks.
    pairs = index.select("segment", "n_words", "terms", "counts", "places").join(
        blocks.withColumnRenamed("terms", "window_terms"))
    return pairs.mapInArrow(search, _MATCH)


def covered(spans: Column) -> Column:
    """Words in the union of (first, last) spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(F.array_sort(spans), start, lambda s, x: F.struct(
        (s["n"] + F.greatest(x["last"] - F.greatest(x["first"], s["to"]), F.lit(0))).alias("n"),
        F.greatest(s["to"], x["last"]).alias("to")), lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, item_ids (sorted), contaminated."""
    index = write_index(docs)
    hits = phrase_matches(index, window_blocks(items, length)).groupBy("segment", "nr").agg(
        covered(F.collect_list(F.struct("first", "last"))).alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "n_words")).alias("nr", "row"))
    out = rows.join(hits, ["segment", "nr"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("row.ids").alias("doc_id"), F.col("row.n_words").alias("n_words"), n_hit.alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """The documents no window of an item occurs in, whether the item has an id or not. Rows are told apart by id and text."""
    rows, restored = numbered(docs, "doc_id", "text")
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    index = write_index(rows.select(F.col("row").alias("doc_id"), "text"))
    hits = phrase_matches(index, window_blocks(items, length)).select("segment", "nr").distinct()
    found = hits.join(index.select("segment", F.posexplode("ids").alias("nr", "row")), ["segment", "nr"]).select("row").distinct()
    return restored(rows.join(found, "row", "left_anti"))

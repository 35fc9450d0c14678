"""Substring deduplication: suffix automata of reference shards and matching statistics.

What a document repeats can be anywhere in the corpus, so the reference is the corpus, and automata of all of it can be
neither held nor sent to every task. Documents are routed to the shards they can match instead. Anchors (the smallest hash of
a 20-word run within every 50-word window, thus the same wherever the window stands) are counted over the corpus; an anchor
that two documents share has its first document, and that document is the shard. Around its shared anchors each document
sends its words to the shards, where one suffix automaton takes the shard's documents in the order of their ids: each is
streamed for its matching statistics, windows of 50 words or more that are found are covered, and what was not found is added.

Anchors of more than ``HOT`` documents (licence texts, copies by the thousand) would make a shard too large. The windows
around them are sent one by one instead and meet by hash, with the smallest id of each kept before the shuffle.

Words are compared by 64-bit hashes. Null texts have no words. A null id counts as larger than any other; rows with the same id
do not remove from each other. An empty table gives no rows; further columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.llm.store import stored
from tapelake.llm.words import Words, as_bytes, runs, text_slices

WINDOW, ANCHOR, HOT = 50, 20, 256
_NO_ID = (1 << 63) - 1


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[:len(values) - (width - span)], values[width - span:]) if span < width else values


def anchors(words: Words, window: int = WINDOW, length: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that are smallest within a window of their text."""
    hashes = runs(words.hashes, length)
    width = window - length + 1
    if len(hashes) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    smallest = _sliding(hashes, width, np.minimum)
    # Windows that reach into the next text choose nothing.
    ends = words.bounds[np.searchsorted(words.bounds, np.arange(len(smallest)), "right")]
    smallest = np.where(np.arange(len(smallest)) + window <= ends, smallest, np.uint64(0))
    around = np.concatenate((np.zeros(width - 1, np.uint64), smallest, np.zeros(width - 1, np.uint64)))
    places = np.flatnonzero(_sliding(around, width, np.maximum)[:len(hashes)] == hashes)
    return places, hashes[places]


class Automaton:
    """Suffix automaton of several strings of numbers."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, symbols: list[int]) -> None:
        nexts, links, lengths = self.next, self.link, self.length
        last = 0
        for c in symbols:
            q = nexts[last].get(c)
            if q is not None and lengths[q] == lengths[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._split(last, q, c)
                continue
            cur = len(nexts)
            nexts.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = cur
                p = links[p]
            if p != -1:
                q = nexts[p][c]
                links[cur] = q if lengths[p] + 1 == lengths[q] else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c: int) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def found(self, symbols: list[int], least: int) -> list[int]:
        """Places where a match of at least that length ends (the matching statistic there reaches it)."""
        nexts, links, lengths = self.next, self.link, self.length
        state = held = 0
        out = []
        for i, c in enumerate(symbols):
            while state and c not in nexts[state]:
                state = links[state]
                held = lengths[state]
            if c in nexts[state]:
                state = nexts[state][c]
                held += 1
            if held >= least:
                out.append(i)
        return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges as ranges in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    return starts[new], reach[np.concatenate((new[1:] - 1, [len(starts) - 1]))]


_ANCHORS = "id bigint, text_id bigint, place int, anchor bigint"


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("text_id", pa.int64()), ("place", pa.int32()), ("anchor", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), as_bytes(batch.column(2))
            for a, b in text_slices(texts):
                words = Words(texts[a:b])
                places, hashes = anchors(words, window)
                of = np.searchsorted(words.bounds, places, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + of]), pa.array(keys[a + of]), pa.array((places - words.bounds[of]).astype(np.int32)),
                                                  pa.array(hashes.view(np.int64))], schema=schema)

    return stored(docs.select("id", "text_id", "text").mapInArrow(find, _ANCHORS), "dedup-anchors")


_SENT = "shard bigint, id bigint, text_id bigint, start int, words binary, window bigint"


def _sent(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """Per document its words around shared anchors: whole ranges for a shard, single windows around hot anchors."""
    schema = pa.schema([("shard", pa.int64()), ("id", pa.int64()), ("text_id", pa.int64()), ("start", pa.int32()),
                        ("words", pa.binary()), ("window", pa.int64())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for i, (ident, text_id, text, found) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
                words = Words([text.encode()]).hashes
                grams = None
                places = np.array([x["place"] for x in found], np.int64)
                shards = np.array([x["shard"] if x["shard"] is not None else -1 for x in found], np.int64)
                hot = np.array([x["shard"] is None for x in found], bool)
                for shard in np.unique(shards[~hot]):
                    own = places[~hot & (shards == shard)]
                    for a, b in zip(*merged(np.maximum(own - (window - ANCHOR), 0), np.minimum(own + window, len(words)))):
                        for column, value in zip(out, (int(shard), ident, text_id, int(a), words[a:b].tobytes(), None)):
                            column.append(value)
                if hot.any():
                    grams = runs(words, window)
                    near = (places[hot][:, None] - np.arange(window - ANCHOR + 1)).ravel()
                    for a in np.unique(near[(near >= 0) & (near < len(grams))]):
                        for column, value in zip(out, (None, ident, text_id, int(a), None, int(grams[a].astype(np.int64)))):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    each = shared.groupBy("id", "text_id").agg(F.collect_set(F.struct("place", "shard")).alias("found"))
    rows = docs.join(each, ["id", "text_id"]).select("id", "text_id", "text", "found")
    return stored(rows.mapInArrow(send, _SENT), "dedup-sent")


def _matched(key: tuple, frame: pd.DataFrame, window: int = WINDOW) -> pd.DataFrame:
    """One shard: its documents in order, each against the automaton of those before it."""
    automaton, out = Automaton(), []
    frame = frame.sort_values(["id", "start"], kind="stable")
    last = frame["id"].iloc[-1]
    for ident, own in frame.groupby("id", sort=True):
        fresh = []
        for text_id, start, words in zip(own["text_id"], own["start"], own["words"]):
            symbols = np.frombuffer(words, np.int64).tolist()
            ends = np.array(automaton.found(symbols, window), np.int64)
            for a, b in zip(*merged(ends - (window - 1), ends + 1)):
                out.append((ident, text_id, start + a, start + b))
            if ident != last:
                new = np.setdiff1d(np.arange(window - 1, len(symbols)), ends, assume_unique=True)
                fresh += [symbols[a:b] for a, b in zip(*merged(new - (window - 1), new + 1))]
        for symbols in fresh:
            automaton.add(symbols)
    return pd.DataFrame(out, columns=["id", "text_id", "first", "last"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """Word ranges of (id, text_id, text) rows that are covered by windows of a document with a smaller id."""
    found = _anchor_rows(docs, window)
    firsts = found.groupBy("anchor").agg(F.min("id").alias("shard"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    firsts = firsts.filter(F.col("shard") < F.col("_last")).select("anchor", F.when(F.col("_n") <= hot, F.col("shard")).alias("shard"))
    # Written, so that the join below deals out both sides itself and can split a hot anchor.
    sent = _sent(docs, found.join(stored(firsts, "dedup-firsts"), "anchor"), window)
    spans = "id bigint, text_id bigint, first bigint, last bigint"
    by_shard = sent.filter(F.col("shard").isNotNull()).select("shard", "id", "text_id", "start", "words")
    matched = by_shard.groupBy("shard").applyInPandas(lambda k, f: _matched(k, f, window), spans)
    windows = sent.filter(F.col("window").isNotNull()).select("window", "id", "text_id", "start")
    first = windows.groupBy("window").agg(F.min("id").alias("_first"))
    again = windows.join(first, "window").filter(F.col("id") > F.col("_first"))
    return matched.unionByName(again.select("id", "text_id", F.col("start").cast("long").alias("first"), (F.col("start") + window).cast("long").alias("last")))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words left, joined by single spaces) and its digest."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(doc_id), F.lit(_NO_ID)).alias("id"),
                       F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_id"), F.coalesce(text, F.lit("")).alias("text"))
    spans = repeated_spans(rows.select("id", "text_id", "text"), window)
    each = spans.groupBy("id", "text_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = rows.join(each, ["id", "text_id"], "left").select("doc_id", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, found in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                kept = words
                if found:
                    left = np.ones(len(words), bool)
                    for x in found:
                        left[x["first"]:x["last"]] = False
                    kept = [words[i] for i in np.flatnonzero(left)]
                whole = b" ".join(kept)
                for column, value in zip(out, (len(words), len(words) - len(kept), whole.decode(), hashlib.sha256(whole).hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[1:]))], schema=schema)

    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")

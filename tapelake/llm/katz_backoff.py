"""Language-model scores: a bigram model with Katz backoff.

Tokens are lower-cased words and one end per text; the first word's history is a start. Counts r become r* by Good-Turing, (r +
1) n(r+1) / n(r) up to five, and from there on r less what five loses; what words lose is the probability of an unknown
word. A bigram seen in training has the probability r* / c(history); any other has the weight of its history times the
probability of its word, and the weight is what makes the history's probabilities add up to one: the loss of its bigrams over
the word probability its bigrams leave. A history never seen has weight one.

Neither words nor bigrams of a corpus fit one place. Documents are dealt into chunks, and tables of words and bigrams are
partitioned by ranges of their hashes; chunks ask the partitions for the counts of what they hold, in packed arrays (see
``chunks``). Each seen bigram is owned by one chunk that holds it, which adds its loss and its word's probability to its
history; histories asked for weights get them from the partition that holds them. A chunk then scores its tokens by the
recursion. Words and bigrams are told apart by hashes of 57 bits at least at any size met in tests, 64 at most.

Null texts count as empty: one token, the end. Null ids are not held out. Repeated rows count as often as they stand there. An
empty table gives no rows; with nothing to train on every text scores 0, as the one unknown token is certain. Further columns
are ignored; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.llm.chunks import chunk_count, chunk_of, expanded, offsets48, range_cuts, squeezed, unpacked48
from tapelake.llm.words import SPACED, Words, as_bytes, mixed, text_slices

START, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: Counts up to this one are discounted by Good-Turing.
GOOD_TURING = 5
_UNIT = 4
_PACKED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string())])
_ROW = "chunk int, range int, kind int, keys binary, a binary, b binary"
_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_NAMES = ["chunk", "range", "kind", "keys", "a", "b"]
_WORDS, _PAIRS, _WEIGHTS, _STATS = range(4)
_SUMS = np.dtype([("loss", np.float64), ("mass", np.float64)])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def discounted(r: np.ndarray, of: np.ndarray) -> np.ndarray:
    """r* for counts r; ``of`` are the numbers of types with counts 0 (not used) to six."""
    stars = np.arange(GOOD_TURING + 1, dtype=float)
    for i in range(1, GOOD_TURING + 1):
        turing = (i + 1) * of[i + 1] / of[i] if of[i] else 0.0
        # Where the counts of counts give no discount, half a count is taken off.
        stars[i] = turing if 0 < turing < i else i - 0.5
    loss = GOOD_TURING - stars[GOOD_TURING]
    return np.where(r <= GOOD_TURING, stars[np.minimum(r, GOOD_TURING)], r - loss)


class _Stats:
    """Tokens, types and numbers of types by count, of words and of bigrams."""

    def __init__(self, rows: list[bytes]):
        words, pairs = np.zeros(9), np.zeros(9)
        for row in rows:
            kind, *values = np.frombuffer(row, np.float64)
            held = words if kind == _WORDS else pairs
            held += values
        self.tokens, self.types, self.of_words, self.of_pairs = words[0], words[1], words[2:], pairs[2:]

    @staticmethod
    def row(kind: int, counts: np.ndarray) -> bytes:
        """One partition's numbers: of its distinct keys with a count."""
        seen = counts[counts > 0]
        return np.array([kind, seen.sum(), len(seen), 0, *[(seen == r).sum() for r in range(1, GOOD_TURING + 2)]], np.float64).tobytes()

    def word_probability(self, counts: np.ndarray) -> np.ndarray:
        """Of words with these counts; of the unknown word where the count is 0."""
        if not self.tokens:
            return np.ones(len(counts))
        few = np.arange(1, GOOD_TURING + 1)
        lost = (self.of_words[1:GOOD_TURING + 1] * (few - discounted(few, self.of_words))).sum()
        many = self.types - self.of_words[1:GOOD_TURING + 1].sum()
        lost += many * (GOOD_TURING - discounted(np.array([GOOD_TURING]), self.of_words)[0])
        return np.where(counts > 0, discounted(counts, self.of_words), lost) / self.tokens


class _Chunk:
    """The tokens of a chunk's documents: numbers of their words, histories and bigrams among the distinct ones."""

    def __init__(self, packed: pa.Table):
        parts = [pa.ipc.open_stream(x).read_all() for x in packed["docs"].to_pylist()]
        docs = pa.concat_tables(parts) if parts else _PACKED.empty_table()
        self.ids, self.held = docs["doc_id"], np.array(docs["held_out"].to_pylist(), bool)
        texts, tokens, lengths = as_bytes(docs["text"]), [np.zeros(0, np.uint64)], []
        for a, b in text_slices(texts):
            words = Words(texts[a:b], SPACED, lower=True)
            tokens.append(np.insert(words.hashes, words.bounds[1:], END))
            lengths.append(np.diff(words.bounds) + 1)
        flat = np.concatenate(tokens)
        self.lengths = np.concatenate([np.zeros(0, np.int64), *lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        history = np.concatenate((np.array([START]), flat[:-1])) if len(flat) else flat
        history[self.starts] = START
        self.train = np.repeat(~self.held, self.lengths)
        self.words, self.word = np.unique(np.concatenate((flat, [START])), return_inverse=True)
        self.start = self.word[-1]
        self.word = self.word[:-1]
        self.history = np.searchsorted(self.words, history)
        self.pairs, self.first, self.pair = np.unique(mixed(mixed(history) * np.uint64(0x9E3779B97F4A7C15) + flat), return_index=True, return_inverse=True)

    def count(self, of: np.ndarray, size: int, train: bool) -> np.ndarray:
        return np.bincount(of[self.train == train], minlength=size)


def _requests(chunk: int, kind: int, keys: np.ndarray, count: int, *values: np.ndarray) -> list[tuple]:
    """Rows that ask each range about its keys."""
    cuts = range_cuts(keys, count)
    rows = []
    for i in range(count):
        a, b = cuts[i], cuts[i + 1]
        if a < b:
            sent = [squeezed(v[a:b]) for v in values]
            rows.append((chunk, i, kind, offsets48(keys[a:b], i, count), *sent, *[None] * (2 - len(sent))))
    return rows


def _answers(side: pa.Table, kind: int, column: str, dtype: type) -> np.ndarray:
    """What the ranges answered, in the order of the chunk's keys."""
    own = side.filter(pa.compute.equal(side["kind"], kind)).sort_by("range")[column].to_pylist()
    return np.concatenate([np.zeros(0, dtype), *[expanded(x, dtype) for x in own]])


def _asked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys' number for each entry, the cuts between requests, and how many distinct keys there are."""
    keys = [unpacked48(k) for k in rows["keys"].to_pylist()]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return at, np.cumsum([0, *map(len, keys)]), len(distinct)


def _joined(rows: pa.Table, column: str, dtype: type) -> np.ndarray:
    return np.concatenate([expanded(x, dtype) for x in rows[column].to_pylist()])


def _pack(docs: DataFrame, held_out: Column, count: int) -> DataFrame:
    """(chunk, docs): documents in compressed pieces."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = batch.column(0).to_numpy()
            rows = batch.select([1, 2, 3]).cast(_PACKED)
            order = np.argsort(chunks, kind="stable")
            names, first = np.unique(chunks[order], return_index=True)
            sent = []
            for own in np.split(order, first[1:]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _PACKED, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows.take(pa.array(own)))
                sent.append(sink.getvalue().to_pybytes())
            if len(names):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(sent, pa.binary())], names=["chunk", "docs"])

    rows = docs.select(chunk_of(F.col("doc_id"), count).alias("chunk"), F.col("doc_id"), held_out.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(pack, "chunk int, docs binary")


def scored(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    count = max(1, chunk_count(docs) // _UNIT)
    packed = _pack(docs, held_out, count).groupBy("chunk")

    def ask_words(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = _Chunk(rows)
        n = len(chunk.words)
        held = (chunk.count(chunk.word, n, False) > 0).astype(np.uint8)
        return _table(_requests(key[0].as_py(), _WORDS, chunk.words, count, chunk.count(chunk.word, n, True), held))

    def tell_words(key: tuple, rows: pa.Table) -> pa.Table:
        at, cuts, n = _asked(rows)
        totals = np.bincount(at, weights=_joined(rows, "a", np.int64), minlength=n).astype(np.int64)
        held = np.bincount(at, weights=_joined(rows, "b", np.uint8), minlength=n) > 0
        known, wanted = totals[at], held[at].astype(np.uint8)
        out = [(c, r, _WORDS, None, squeezed(known[a:b]), squeezed(wanted[a:b]))
               for c, r, a, b in zip(rows["chunk"].to_pylist(), rows["range"].to_pylist(), cuts[:-1], cuts[1:])]
        return _table([*out, (-1, key[0].as_py(), _STATS, None, _Stats.row(_WORDS, totals), None)])

    def ask_pairs(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = _Chunk(rows)
        return _table(_requests(key[0].as_py(), _PAIRS, chunk.pairs, count, chunk.count(chunk.pair, len(chunk.pairs), True).astype(np.uint32)))

    def tell_pairs(key: tuple, rows: pa.Table) -> pa.Table:
        # The lowest chunk that has a bigram owns it, in whatever order the requests came.
        rows = rows.sort_by("chunk")
        at, cuts, n = _asked(rows)
        totals = np.bincount(at, weights=_joined(rows, "a", np.uint32), minlength=n).astype(np.int64)
        _, first = np.unique(at, return_index=True)
        owner = np.zeros(len(at), np.uint8)
        owner[first] = 1
        counts = totals[at]
        out = [(c, r, _PAIRS, None, squeezed(counts[a:b]), squeezed(owner[a:b]))
               for c, r, a, b in zip(rows["chunk"].to_pylist(), rows["range"].to_pylist(), cuts[:-1], cuts[1:])]
        return _table([*out, (-1, key[0].as_py(), _STATS, None, _Stats.row(_PAIRS, totals), None)])

    def ask_weights(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        chunk, stats = _Chunk(rows), _Stats(_stats(side))
        word_counts, wanted = _answers(side, _WORDS, "a", np.int64), _answers(side, _WORDS, "b", np.uint8).astype(bool)
        counts, owner = _answers(side, _PAIRS, "a", np.int64), _answers(side, _PAIRS, "b", np.uint8)
        own = chunk.first[(counts > 0) & (owner == 1)]
        own_counts = counts[chunk.pair[own]]
        n = len(chunk.words)
        loss = np.bincount(chunk.history[own], weights=own_counts - discounted(own_counts, stats.of_pairs), minlength=n)
        mass = np.bincount(chunk.history[own], weights=stats.word_probability(word_counts[chunk.word[own]]), minlength=n)
        # Only histories of held-out texts can need a weight; a start is one if there is any such text.
        wanted = wanted | (np.arange(n) == chunk.start)
        unseen = np.zeros(n, bool)
        unseen[chunk.history[counts[chunk.pair] == 0]] = True
        some = np.flatnonzero(((loss > 0) & wanted) | unseen)
        return _table(_requests(key[0].as_py(), _WEIGHTS, chunk.words[some], count, np.rec.fromarrays([loss[some], mass[some]], dtype=_SUMS), unseen[some].astype(np.uint8)))

    def tell_weights(key: tuple, rows: pa.Table) -> pa.Table:
        at, cuts, n = _asked(rows)
        sums = _joined(rows, "a", _SUMS)
        loss, mass = (np.bincount(at, weights=sums[x], minlength=n) for x in _SUMS.names)
        # Times the count of the history, which chunks know: the weight is the loss over it and over the mass left.
        weight = np.where(_joined(rows, "b", np.uint8) == 1, (loss / (1 - mass))[at], 0)
        return _table([(c, r, _WEIGHTS, None, squeezed(weight[a:b]), None)
                       for c, r, a, b in zip(rows["chunk"].to_pylist(), rows["range"].to_pylist(), cuts[:-1], cuts[1:])])

    def score(key: tuple, rows: pa.Table, side: pa.Table) -> pa.Table:
        chunk, stats = _Chunk(rows), _Stats(_stats(side))
        word_counts, wanted = _answers(side, _WORDS, "a", np.int64), _answers(side, _WORDS, "b", np.uint8).astype(bool)
        counts, owner = _answers(side, _PAIRS, "a", np.int64), _answers(side, _PAIRS, "b", np.uint8)
        n = len(chunk.words)
        pair_counts = counts[chunk.pair]
        # The same keys as were asked for, found the same way.
        own = chunk.first[(counts > 0) & (owner == 1)]
        loses = np.zeros(n, bool)
        loses[chunk.history[own]] = True
        wanted = wanted | (np.arange(n) == chunk.start)
        unseen = np.zeros(n, bool)
        unseen[chunk.history[pair_counts == 0]] = True
        weights = np.zeros(n)
        weights[np.flatnonzero((loses & wanted) | unseen)] = _answers(side, _WEIGHTS, "a", np.float64)
        known = word_counts[chunk.word]
        # A start was seen as often as training texts end.
        as_history = word_counts.copy()
        as_history[chunk.start] = word_counts[np.searchsorted(chunk.words, END)] if n > 1 else 0
        histories = np.maximum(as_history[chunk.history], 1)
        word_p = stats.word_probability(known)
        backed = np.where(as_history[chunk.history] > 0, weights[chunk.history] / histories, 1.0) * word_p
        p = np.where(pair_counts > 0, discounted(pair_counts, stats.of_pairs) / histories, backed)
        base = np.log10((known + 0.5) / (stats.tokens + 0.5 * (stats.types + 1)))
        total = lambda x: np.add.reduceat(x, chunk.starts) if len(x) else np.zeros(0, x.dtype)
        return pa.table([chunk.ids.combine_chunks(), pa.array(chunk.held), pa.array(chunk.lengths), pa.array(total((known > 0).astype(np.int64))),
                         pa.array(np.full(len(chunk.lengths), int(stats.tokens))), pa.array(total(base)), pa.array(total(np.log10(p)))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def _stats(side: pa.Table) -> list[bytes]:
        return [x for row in side.filter(pa.compute.equal(side["kind"], _STATS))["a"].to_pylist() for x in _split(row)]

    def _split(row: bytes) -> list[bytes]:
        return [row[i:i + 80] for i in range(0, len(row), 80)]

    told_words = packed.applyInArrow(ask_words, _ROW).groupBy("range").applyInArrow(tell_words, _ROW)
    told_pairs = packed.applyInArrow(ask_pairs, _ROW).groupBy("range").applyInArrow(tell_pairs, _ROW)
    known = told_words.unionByName(told_pairs)

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        numbers = np.stack([np.frombuffer(x, np.float64) for x in rows["a"].to_pylist()])
        return _table([(-1, -1, _STATS, None, np.concatenate(([numbers[0, 0]], numbers[:, 1:].sum(axis=0))).tobytes(), None)])

    # Two rows of nine numbers, for every chunk. Each partition sent one row: they are few, and are added up by kind.
    stats = known.filter(F.col("kind") == _STATS).groupBy(F.substring("a", 1, 8)).applyInArrow(summed, _ROW)
    chunks = spark.range(count).select(F.col("id").cast("int").alias("_chunk"))
    stats = chunks.join(F.broadcast(stats)).withColumn("chunk", F.col("_chunk")).drop("_chunk")
    told = known.filter(F.col("kind") != _STATS).unionByName(stats)
    told_weights = packed.cogroup(told.groupBy("chunk")).applyInArrow(ask_weights, _ROW).groupBy("range").applyInArrow(tell_weights, _ROW)
    every = told.unionByName(told_weights)
    return packed.cogroup(every.groupBy("chunk")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased code points with everything that is not a letter turned into a space; n-grams of one to three of them
are hashed into buckets, those of spaces only left out. Training counts all n-grams of all training rows, summed by language
and bucket. The matrix of log probabilities (languages by buckets, its size checked) is broadcast, and batches are scored by
adding up looked-up rows.

A null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing could be learned. Rows with
null language teach nothing. Ties go to the language that sorts first. Repeated rows count as often as they stand there.
Texts are read whole, in slices of bounded size. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 15
_SIZES = (1, 2, 3)
#: Languages that a model may hold: at 2**15 buckets and four bytes the matrix stays within 256 MB.
MAX_LANGUAGES = 2048
UNDETERMINED = "und"
_SLICE = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > _SLICE:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def features(texts: list[str], bits: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bucket of the n-gram at every place, one array per size; where each text begins; how many letters it has.

    Each text has two spaces before it, so no n-gram has letters of two texts. Bucket 2**bits stands for spaces only.
    """
    points = np.frombuffer("".join(["  " + t.lower() for t in texts] + ["  "]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))[:-1]
    letter = _letters()[points]
    points = np.where(letter, points, 32).astype(np.uint64)
    out, n = [], len(points) - 2
    for size in _SIZES:
        h = np.full(n, size, np.uint64)
        blank = np.ones(n, bool)
        for j in range(size):
            h = (h + points[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            blank &= ~letter[j:j + n]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
        bucket[blank] = 1 << bits
        out.append(bucket)
    return out, starts, np.add.reduceat(letter[:n].astype(np.int64), starts)


def ngram_counts(rows: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """(lang, bucket, n) over rows of (lang, text); bucket -1 counts texts."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows_out() -> Iterator[pa.RecordBatch]:
            for lang, held in sums.items():
                at = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array((at - 1).astype(np.int32)), pa.array(held[at])], schema=schema)

        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                buckets, starts, _ = features(texts[a:b], bits)
                ends = np.concatenate((starts[1:], [len(buckets[0])]))
                for lang in set(langs[a:b]):
                    held = sums.setdefault(lang, np.zeros((1 << bits) + 2, np.int64))
                    own = np.repeat(langs[a:b] == lang, ends - starts)
                    held[0] += int((langs[a:b] == lang).sum())
                    for x in buckets:
                        held[1:-1] += np.bincount(x[own], minlength=(1 << bits) + 1)[:-1]
            if len(sums) > 64:
                yield from rows_out()
                sums.clear()
        yield from rows_out()

    return rows.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order and their log probabilities; one column more, of zeros, for what is left out."""

    def __init__(self, counts: DataFrame, bits: int = BUCKET_BITS, smoothing: float = 0.1):
        self.bits = bits
        languages = [r[0] for r in counts.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages: the matrix of log probabilities would be too large to broadcast")
        self.languages = languages
        table = counts.toArrow()
        sums = np.zeros((len(languages), (1 << bits) + 1))
        number = {x: i for i, x in enumerate(languages)}
        rows = np.array([number[x] for x in table["lang"].to_pylist()], np.int64)
        np.add.at(sums, (rows, table["bucket"].to_numpy().astype(np.int64) + 1), table["n"].to_numpy())
        texts, seen = sums[:, 0], sums[:, 1:] + smoothing
        self.log_p = np.zeros((len(languages), (1 << bits) + 1), np.float32)
        self.log_p[:, :-1] = np.log(seen / seen.sum(axis=1, keepdims=True)) if languages else 0
        self.prior = np.log(np.maximum(texts, 1) / max(texts.sum(), 1))


def predictions(rows: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred and score, the model's probability of that language."""
    sent = rows.sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.prior, model.bits))
    schema = rows.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, log_p, prior, bits = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            names: list[str] = [UNDETERMINED] * len(texts)
            scores = np.zeros(len(texts))
            for a, b in _slices(texts) if languages else ():
                buckets, starts, letters = features(texts[a:b], bits)
                sums = np.zeros((len(languages), b - a))
                for i in range(len(languages)):
                    sums[i] = prior[i]
                    for x in buckets:
                        sums[i] += np.add.reduceat(log_p[i][x], starts, dtype=np.float64)
                best = sums.argmax(axis=0)
                share = 1 / np.exp(sums - sums.max(axis=0)).sum(axis=0)
                for j in np.flatnonzero(letters):
                    names[a + j], scores[a + j] = languages[best[j]], share[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores)],
                                             names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.select(*keep, F.col(text).alias("_text")).mapInArrow(score, schema)


def held_out(doc_id: Column, parts: int, part: int = 1) -> Column:
    """Whether the checksum of the id as text leaves the rest ``part``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(parts)) == part, F.lit(False))


def identified(docs: DataFrame, parts: int = 3) -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    out = held_out(F.col("doc_id"), parts)
    taught = docs.filter(~out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = Model(ngram_counts(taught))
    return predictions(docs.withColumn("held_out", out).select("doc_id", "held_out", "text"), model, ["doc_id", "held_out"])

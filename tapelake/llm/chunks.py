"""Counting keys of all documents and handing the counts back, in packed arrays.

Documents are dealt into chunks by a hash. A chunk asks for its distinct 64-bit keys, packed by ranges of the key: one row a
chunk and range. A range adds up what all chunks sent and answers each with an array in the order of its request, so answers
need no keys, and a chunk that puts its answers together in the order of the ranges has one value for each of its keys. An
answer depends on the requests alone and not on their order, so one that is worked out again is the same.

Chunks and ranges both number about the square root of the text's size in units of two kilobytes, so requests stay about
that long and neither side ever holds more than its share. Keys travel as 48 bits where they only steer a search, as 64
where they must be exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNIT = 2048


def chunk_count(docs: DataFrame, text: str = "text") -> int:
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return math.isqrt(size // _UNIT) + 1


def chunk_of(doc_id: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(count)).cast("int")


def range_cuts(keys: np.ndarray, count: int) -> np.ndarray:
    """Where each of ``count`` equal ranges of the key space begins in the sorted keys, and their end."""
    edges = np.array([(i << 64) // count for i in range(1, count)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))


def squeezed(values: np.ndarray) -> bytes:
    """Values of fixed length, byte by byte in planes and compressed."""
    plain = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def expanded(data: bytes, dtype: type) -> np.ndarray:
    plain = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    planes = np.frombuffer(plain, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def packed48(keys: np.ndarray) -> bytes:
    """The upper 48 bits of sorted keys, as steps from one to the next."""
    return squeezed(np.diff(keys >> np.uint64(16), prepend=np.uint64(0)))


def unpacked48(data: bytes) -> np.ndarray:
    return np.cumsum(expanded(data, np.uint64), dtype=np.uint64) << np.uint64(16)


def totals(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every entry the sum of the counts of all entries with its key."""
    _, at = np.unique(keys, return_inverse=True)
    return np.bincount(at, weights=counts, minlength=1)[at].astype(np.int64)


def offsets48(keys: np.ndarray, at: int, count: int) -> bytes:
    """Sorted keys of one of ``count`` ranges: the upper 48 bits of what distinguishes keys there.

    With the number of the range this tells keys apart by 48 bits and those the range itself stands for, up to all 64.
    """
    offset = keys - np.uint64(((at << 64) + count - 1) // count)
    spare = max(0, 64 - count.bit_length() + 1 - 48)
    return packed48((offset >> np.uint64(spare)) << np.uint64(16))

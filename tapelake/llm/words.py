"""Words of many texts as 64-bit hashes, worked out with numpy over UTF-8 bytes.

A word is a run of bytes of one class; its hash is a polynomial over tabulated byte values modulo 2**64, finished with a
mixer. Blocks of fixed length bound the memory beside the result, also where one text or one word is very long.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 18
_RADIX = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value spread over all bits (one to one)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))




def _powers(base: int) -> np.ndarray:
    factors = np.full(_BLOCK + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


_POWERS, _INVERSE = _powers(_RADIX), _powers(pow(_RADIX, -1, 1 << 64))
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]

#: Bytes of words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def word_edges(buf: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in a byte buffer."""
    values = _LOWER_VALUES if lower else _BYTE_VALUES
    at_edges, sums, inverses = [], [], []
    carry, scale, inverse, before = 0, 1, 1, False
    for at in range(0, len(buf), _BLOCK):
        block = buf[at:at + _BLOCK]
        inside = is_word[block]
        prefix = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(values[block] * _POWERS[:len(block)], out=prefix[1:])
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0] != before:
            edges = np.concatenate(([0], edges))
        at_edges.append(edges + at)
        sums.append(prefix[edges] * np.uint64(scale) + np.uint64(carry))
        inverses.append(_INVERSE[edges] * np.uint64(inverse))
        carry = (carry + scale * int(prefix[-1])) & _MASK
        scale = scale * int(_POWERS[len(block)]) & _MASK
        inverse = inverse * int(_INVERSE[len(block)]) & _MASK
        before = bool(inside[-1])
    if before:
        at_edges.append(np.array([len(buf)]))
        sums.append(np.array([carry], np.uint64))
        inverses.append(np.array([0], np.uint64))
    if not at_edges:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, np.uint64)
    edges, sums, inverses = np.concatenate(at_edges), np.concatenate(sums), np.concatenate(inverses)
    return edges[0::2], edges[1::2], mixed((sums[1::2] - sums[0::2]) * inverses[0::2])


class Words:
    """The words of some texts: ``hashes`` in order, of text i those from ``bounds[i]`` to ``bounds[i + 1]``."""

    def __init__(self, texts: Sequence[bytes | None], is_word: np.ndarray = SPACED, lower: bool = False):
        self.data = b"\n".join([t or b"" for t in texts])
        lengths = np.array([len(t or b"") + 1 for t in texts], np.int64)
        offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        self.starts, self.ends, self.hashes = word_edges(np.frombuffer(self.data, np.uint8), is_word, lower)
        self.bounds = np.searchsorted(self.starts, offsets)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist() if pa.types.is_string(column.type) else column.cast(pa.large_binary()).to_pylist()


def text_slices(texts: Sequence[bytes | None], size: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes each; a longer text is a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and held + n > size:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def runs(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of every k consecutive word hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n]
    return mixed(out)

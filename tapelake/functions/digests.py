"""Digests of text and bytes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelake.functions.numbers import as_column


def _framed_length(part: Column) -> Column:
    return F.concat(F.octet_length(part).cast("string").cast("binary"), F.unhex(F.lit("00")))


def canonical_prefix(*parts: Column | str) -> Column:
    """Each part as its decimal byte length, a NUL byte, and the bytes."""
    framed = []
    for part in parts:
        part = as_column(part)
        framed += [_framed_length(part), part.cast("binary")]
    return F.concat(*framed)


def canonical_frame(symbol: Column | str, header: Column | str, body: Column | str) -> Column:
    """The bytes a source file's digest is taken over: symbol, header and body, each framed by its length."""
    return canonical_prefix(symbol, header, body)


def rollup_digest(name: Column | str, digest: Column | str) -> Column:
    """Aggregate: one digest over ``name NUL digest newline`` lines in name order."""
    pairs = F.sort_array(F.collect_list(F.struct(as_column(name).alias("name"), as_column(digest).alias("digest"))))
    lines = F.transform(pairs, lambda p: F.concat(p["name"], F.lit("\x00"), p["digest"], F.lit("\n")))
    return F.sha2(F.array_join(lines, ""), 256)

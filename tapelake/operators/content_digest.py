"""Digests of table content that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelake.functions import rollup_digest

#: Numbers a block of rows spans: a group never collects more rows than that.
BLOCK = 4096


def content_digests(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One SHA-256 per ``keys`` of rows (``name``, ``line``, a unique whole number ``order``), null lines counting as empty.

    A block holds a name's rows whose number falls into the same span of 4096: SHA-256 of their lines, each with a line
    feed, in order. A name's digest is that of its blocks' ``number NUL digest newline`` lines, the whole that of the
    names' in name order. Blocks of a hot name are hashed apart, and their digests are 4096 times fewer than its rows.
    """
    ordered = F.sort_array(F.collect_list(F.struct(order, F.coalesce("line", F.lit("")).alias("line"))))
    text = F.array_join(F.transform(ordered, lambda r: F.concat(r["line"], F.lit("\n"))), "")
    blocks = rows.withColumn("block", F.floor(F.col(order) / BLOCK).cast("bigint")).groupBy(*keys, "name", "block") \
        .agg(F.sha2(text, 256).alias("digest"))
    number = F.lpad(F.col("block").cast("string"), 20, "0")
    names = blocks.groupBy(*keys, "name").agg(rollup_digest(number, "digest").alias("digest"))
    return names.groupBy(*keys).agg(rollup_digest("name", "digest").alias("digest"))

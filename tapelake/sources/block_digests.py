"""Digests of what a store's days hold, in two levels kept beside it, so that copies are told by them and not by a scan.

A day of a stream is cut into blocks by the places of its rows over all its part files, so stores with other part files have the
same blocks. ``_index/blocks`` holds a row a block: its rows, a digest of its cells, its nulls by column; ``_index/days`` holds a
row a day, the same over its blocks. Both are keyed by the day's state, a digest of its files' names, lengths and times of change:
a day with another file has another state and counts as unknown, entries of states that are gone are never looked at. Two stores
are compared from the top: days with unlike digests, then unlike blocks of these days, then rows of these blocks, for which only
files that hold some are read. Blocks are appended before their day; a job that dies in between is repeated whole, and as an entry
is a function of its key, readers take one of each.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapelake.schema import ROW_GROUP_ROWS
from tapelake.session import small_frame
from tapelake.sources.raw_store import file_order, scan, store_files
from tapelake.sources.store_index import KEYS, append_rows, index_path, stored_table, with_footers

#: Rows of a block. Stored digests are of this size, so another one needs another index.
BLOCK_ROWS = ROW_GROUP_ROWS
_DIGEST = "n bigint, x bigint, y bigint, nulls map<string,bigint>"
BLOCKS = f"stream string, state string, block bigint, {_DIGEST}"
DAYS = f"stream string, state string, {_DIGEST}"
STATES = "stream string, day date, state string"


def block_of(place: str) -> Column:
    """The block a place falls into."""
    return F.call_function("div", F.col(place), F.lit(BLOCK_ROWS))


def nonzero_counts(columns: list[str], value) -> Column:
    """A map of the columns whose count is not zero."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), value(c).alias("value")) for c in columns])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


def block_digests(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per block of rows: rows, a 128-bit digest over (position, cells) with null and '' alike, values per column.

    The digest is the xor of two seeded row hashes, so it combines before the shuffle and needs no row order.
    """
    cells = [F.coalesce(F.col(c), F.lit("")) for c in columns]
    return rows.withColumn("block", block_of("pos")).groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("pos", *cells)).alias("x"),
        F.bit_xor(F.xxhash64(*reversed(cells), "pos", F.lit(1))).alias("y"), *[F.count(c).alias(f"has__{c}") for c in columns])


def positions(spark: SparkSession, root: str, stream: str, days: list[dt.date], columns: list[str],
              blocks: DataFrame | None = None) -> DataFrame:
    """Rows of some days with ``pos``, the place over all part files of the day in the order of their numbers, from footers.

    With ``blocks`` (day, block) only their rows, from files that hold some of them.
    """
    files = store_files(spark, root, (stream,)).filter(F.col("day").isin(days))
    per_file = with_footers(files.select("day", "path", *KEYS), root).select("day", "path", F.col("file_rows").alias("n"))
    before = Window.partitionBy("day").orderBy(*file_order("path")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_file.select("day", F.substring_index("path", "/", -1).alias("__name"), "n",
                              F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    # one row a file, like the listing: of known size, so that rows need no shuffle to meet it
    offsets = small_frame(spark, [tuple(r) for r in offsets.collect()], "day date, __name string, n bigint, __offset bigint")
    rows = scan(spark, root, stream, days, columns, place=True).withColumn("__name", F.substring_index("__file", "/", -1))
    if blocks is not None:
        held = offsets.filter("n > 0").withColumn("__last", F.col("__offset") + F.col("n") - 1) \
            .select("day", "__name", F.explode(F.sequence(block_of("__offset"), block_of("__last"))).alias("block"))
        # names as literals: the listing of the scan is cut down by them
        names = held.join(blocks, ["day", "block"], "left_semi").select("__name").distinct().collect()
        rows = rows.filter(F.col("__name").isin([r["__name"] for r in names]))
    placed = rows.join(offsets.drop("n"), ["day", "__name"]).withColumn("pos", F.col("__row") + F.col("__offset"))
    if blocks is not None:
        placed = placed.withColumn("block", block_of("pos")).join(blocks, ["day", "block"], "left_semi").drop("block")
    return placed.drop("__file", "__row", "__name", "__offset")


def day_states(spark: SparkSession, root: str, streams: tuple[str, ...], days: list[dt.date]) -> DataFrame:
    """(stream, day, state) of days with files: a digest of what the listing says of them."""
    files = store_files(spark, root, streams).filter(F.col("day").isin(days))
    lines = F.sort_array(F.collect_list(F.concat_ws(" ", *KEYS)))
    return files.groupBy("stream", "day").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("state"))


def _rolled(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """A row a state over its blocks; a day without rows has none."""
    key = ["stream", "state"]
    sums = blocks.groupBy(*key).agg(
        F.sum("n").alias("n"), F.bit_xor(F.xxhash64("block", "n", "x", "y")).alias("x"),
        F.bit_xor(F.xxhash64("y", "x", "n", "block", F.lit(1))).alias("y"))
    nulls = blocks.select(*key, F.explode("nulls")).groupBy(*key, "key").agg(F.sum("value").alias("value")) \
        .groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("nulls"))
    none = F.create_map().cast("map<string,bigint>")
    return states.select(*key).join(sums, key, "left").join(nulls, key, "left").fillna(0, ["n", "x", "y"]) \
        .withColumn("nulls", F.coalesce("nulls", none))


def day_digests(spark: SparkSession, root: str, wanted: dict[tuple[str, tuple[str, ...]], list[dt.date]]) -> DataFrame:
    """(stream, day, state, n, x, y, nulls) of the wanted days, by stream and its columns there. Scans only days of unknown state."""
    streams, days = tuple(sorted({s for s, _ in wanted})), sorted({d for own in wanted.values() for d in own})
    if not wanted:
        return small_frame(spark, [], f"{STATES}, {_DIGEST}")
    index = index_path(spark, root)
    asked = {(s, d) for (s, _), own in wanted.items() for d in own}
    states = small_frame(spark, [tuple(r) for r in day_states(spark, root, streams, days).collect() if (r["stream"], r["day"]) in asked], STATES)
    missing = states.join(stored_table(spark, f"{index}/days", DAYS), ["stream", "state"], "left_anti").select("stream", "day", "state").collect()
    if missing:
        unknown, parts = small_frame(spark, [tuple(r) for r in missing], STATES), []
        for (stream, columns), own in sorted(wanted.items()):
            scanned = [r["day"] for r in missing if r["stream"] == stream and r["day"] in own]
            if scanned:
                found = block_digests(positions(spark, root, stream, scanned, list(columns)), ["day"], list(columns))
                nulls = nonzero_counts(list(columns), lambda c: F.col("n") - F.col(f"has__{c}"))
                parts.append(found.select(F.lit(stream).alias("stream"), "day", "block", "n", "x", "y", nulls.alias("nulls")))
        blocks = reduce(DataFrame.unionByName, parts).join(unknown, ["stream", "day"])
        append_rows(blocks.select("stream", "state", "block", "n", "x", "y", "nulls"), f"{index}/blocks")
        append_rows(_rolled(_blocks(spark, root, unknown), unknown), f"{index}/days")
    return states.join(stored_table(spark, f"{index}/days", DAYS).dropDuplicates(["stream", "state"]), ["stream", "state"])


def _blocks(spark: SparkSession, root: str, states: DataFrame) -> DataFrame:
    """(stream, state, block, n, x, y, nulls) of some states."""
    known = stored_table(spark, f"{index_path(spark, root)}/blocks", BLOCKS).join(states.select("stream", "state"), ["stream", "state"], "left_semi")
    # maps do not compare, so duplicates go by key
    return known.dropDuplicates(["stream", "state", "block"])


def unlike_blocks(spark: SparkSession, roots: tuple[str, str], pairs: DataFrame) -> DataFrame:
    """(stream, day, block) whose digests differ, of the days ``pairs`` (stream, day, state_a, state_b)."""
    sides = []
    for root, state in zip(roots, ("state_a", "state_b")):
        states = pairs.select("stream", "day", F.col(state).alias("state"))
        sides.append(_blocks(spark, root, states).drop("nulls").join(states, ["stream", "state"]))
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "x", "y")])
    return sides[0].alias("a").join(sides[1].alias("b"), ["stream", "day", "block"], "full_outer").filter(~same) \
        .select("stream", "day", "block")

"""What is known of a store's files, kept beside them so that no file is opened for it twice.

Tables below ``{root}/_index``, keyed by a file's name in the store, its length and its time of change: footers, a row a file,
and presence, the symbols of a file as bitmaps. Leaves, the digests of source files, have the source tree in their key as well. A
file that changed has another key and counts as unknown. Refreshing appends what the tables lack, found by an anti join of the
listing; entries of files that are gone are never looked at. Two writers may append the same entries: an entry is a function of
its key, and readers take one of each. ``sources/v=RUN`` holds the names and digests that the days of a run are bound to.

A symbol is six digits and a market, so it has a number below two million; a bitmap row covers ``BUCKET`` numbers, at most 62
rows a file. Names of other shapes cannot be requested and are left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.schema import SYMBOL_COL, SYMBOL_MARKETS
from tapelake.session import qualified, small_frame
from tapelake.sources.files import file_footers, path_exists

KEYS = ["rel", "length", "modified"]
_KEYS = "rel string, length bigint, modified bigint"
FOOTERS = f"""{_KEYS}, file_rows bigint, columns array<string>, types array<string>, groups array<struct<
row_group:int, rows:bigint, byte_size:bigint, symbol_min:string, symbol_max:string, has_range:boolean>>"""
PRESENCE = f"{_KEYS}, bucket int, bits binary"
LEAF_KEYS = ["root", *KEYS]
LEAVES = f"root string, {_KEYS}, header binary, body_offset bigint, sha256 string"
BOUND = "day date, rel string, sha256 string"
#: Numbers in a bitmap of Spark's bitmap functions.
BUCKET = 8 * 4096


def index_path(spark: SparkSession, root: str) -> str:
    return f"{qualified(spark, root).rstrip('/')}/_index"


def stored_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the index, empty where there is none yet."""
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else small_frame(spark, [], schema)


def append_rows(rows: DataFrame, path: str) -> None:
    """Add rows to a table of the index."""
    # a shuffle of these few rows keeps the work that finds them spread
    rows.repartition(8).write.mode("append").option("compression", "zstd").parquet(path)


def symbol_number(symbol: Column) -> Column:
    """A symbol's number; null for names of another shape."""
    digits, market = F.substring(symbol, 1, 6), F.substring(symbol, 8, 2)
    place = F.array_position(F.array(*map(F.lit, SYMBOL_MARKETS)), market) - 1
    shaped = symbol.rlike(rf"^[0-9]{{6}}\.({'|'.join(SYMBOL_MARKETS)})$")
    return F.when(shaped, digits.try_cast("int") * len(SYMBOL_MARKETS) + place.cast("int"))


def bucket_of(number: Column) -> Column:
    return F.call_function("div", number, F.lit(BUCKET)).cast("int")


def has_bit(bits: Column, position: Column) -> Column:
    """Whether a bitmap has a bit: bits of a byte count from its lowest."""
    byte = F.call_function("substring", bits, F.call_function("div", position, F.lit(8)).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), position % 8) == 1


def with_footers(files: DataFrame, root: str, index: str | None = None) -> DataFrame:
    """``files`` (path and keys among their columns) with file_rows, columns, types and groups. Opens unknown files only."""
    spark = files.sparkSession
    path = f"{index or index_path(spark, root)}/footers"
    unknown = files.select("path", *KEYS).join(stored_table(spark, path, FOOTERS).select(*KEYS), KEYS, "left_anti")
    if not unknown.isEmpty():
        append_rows(file_footers(unknown).drop("path"), path)
    return files.join(stored_table(spark, path, FOOTERS).dropDuplicates(KEYS), KEYS)


def unfolded(footers: DataFrame) -> DataFrame:
    """A row a row group; a file without row groups has one with nulls."""
    kept = [c for c in footers.columns if c not in ("groups", *KEYS)]
    rows = footers.select(*kept, F.explode_outer("groups").alias("__g")).select(*kept, "__g.*")
    return rows.withColumn("has_range", F.coalesce("has_range", F.lit(True)))


def presence(files: DataFrame, root: str, index: str | None = None) -> DataFrame:
    """Bitmap rows of those files whose symbols are recorded; a file without any has one row with nulls."""
    spark = files.sparkSession
    known = stored_table(spark, f"{index or index_path(spark, root)}/presence", PRESENCE)
    return files.join(known.dropDuplicates([*KEYS, "bucket"]), KEYS)


def symbol_bitmaps(symbols: DataFrame, file: str) -> DataFrame:
    """(file, bucket, bits) of rows (file, symbol): one bitmap a file and bucket.

    A row's number is made once, behind an explode, and its file is left as the scan names it.
    """
    numbers = symbols.select(file, F.explode(F.array(symbol_number(F.col(SYMBOL_COL)))).alias("n")).filter("n is not null")
    return numbers.groupBy(file, bucket_of(F.col("n")).alias("bucket")).agg(
        F.bitmap_construct_agg((F.col("n") % BUCKET).cast("bigint")).alias("bits"))


def record_presence(files: DataFrame, bitmaps: DataFrame, root: str, index: str | None = None) -> None:
    """Record the symbols of ``files`` that are not recorded yet, from ``bitmaps`` (rel, bucket, bits) of at least those files."""
    spark = files.sparkSession
    path = f"{index or index_path(spark, root)}/presence"
    unknown = files.select(*KEYS).join(stored_table(spark, path, PRESENCE).select(*KEYS), KEYS, "left_anti")
    append_rows(unknown.join(bitmaps, "rel", "left"), path)


def unrecorded(files: DataFrame, root: str, index: str | None = None) -> DataFrame:
    """The files whose symbols are not recorded."""
    spark = files.sparkSession
    known = stored_table(spark, f"{index or index_path(spark, root)}/presence", PRESENCE)
    return files.join(known.select(*KEYS), KEYS, "left_anti")


def with_leaves(files: DataFrame, root: str, hashed: Callable[[DataFrame], DataFrame], anew: bool = False) -> DataFrame:
    """``files`` of source trees (leaf keys among their columns) with header, body_offset and sha256.

    ``hashed`` adds the three by opening files. It is given those without a leaf, or all of them if they are to be hashed ``anew``.
    """
    if anew:
        return hashed(files)
    spark = files.sparkSession
    path = f"{index_path(spark, root)}/leaves"
    known = stored_table(spark, path, LEAVES).select(*LEAF_KEYS)
    unknown = files.join(known, LEAF_KEYS, "left_anti")
    if not unknown.isEmpty():
        append_rows(hashed(unknown).select(*known.columns, "header", "body_offset", "sha256"), path)
    return files.join(stored_table(spark, path, LEAVES).dropDuplicates(LEAF_KEYS), LEAF_KEYS)


def bind_sources(files: DataFrame, root: str, run: str) -> None:
    """Record what the days of a run were made from, for ``source_changes``."""
    append_rows(files.select("day", "rel", "sha256"), f"{index_path(files.sparkSession, root)}/sources/v={run}")


def source_changes(files: DataFrame, root: str, runs: dict[dt.date, str]) -> DataFrame:
    """(day, rel, change) of source files that are altered, added or missing since the given days' runs were bound to them.

    Days without such a record, published before there were any, have no rows.
    """
    spark = files.sparkSession
    days: dict[str, list[dt.date]] = {}
    for day, run in runs.items():
        days.setdefault(run, []).append(day)
    none = small_frame(spark, [], BOUND)
    bound = reduce(DataFrame.unionByName, [stored_table(spark, f"{index_path(spark, root)}/sources/v={run}", BOUND)
                                           .filter(F.col("day").isin(own)) for run, own in sorted(days.items())], none)
    told = bound.select("day").distinct()
    both = files.join(told, "day", "left_semi").select("day", "rel", "sha256").alias("n") \
        .join(bound.alias("o"), ["day", "rel"], "full_outer")
    change = F.when(F.col("o.sha256").isNull(), "added").when(F.col("n.sha256").isNull(), "missing") \
        .when(F.col("o.sha256") != F.col("n.sha256"), "altered")
    return both.select("day", "rel", change.alias("change")).filter("change is not null")

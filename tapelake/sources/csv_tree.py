"""Source trees of one CSV per day, symbol and stream: ``{YYYYMMDD}/{symbol}/{csv}`` or ``{symbol}/{csv}``.

A CSV is one GBK header line and ASCII lines below it. Lines are read with the splittable text source, so one very
large file spreads over many tasks, and bytes arrive as they are: NUL stays NUL and nothing is unquoted.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapelake.schema import CSV_NAME
from tapelake.session import qualified, small_frame
from tapelake.sources.files import list_files


class SourceError(RuntimeError):
    """The source tree has an unregistered shape."""


def stream_of(name: Column) -> Column:
    """The stream a CSV name stands for; null for any other name."""
    return reduce(lambda acc, s: acc.when(name == CSV_NAME[s], s), list(CSV_NAME)[1:],
                  F.when(name == next(iter(CSV_NAME.values())), next(iter(CSV_NAME))))


def tree_files(spark: SparkSession, trees: dict[dt.date, str]) -> DataFrame:
    """(day, root, rel, length, modified) for every file of the trees, empty files included. Opens none."""
    roots = small_frame(spark, [(qualified(spark, t).rstrip("/"), d) for d, t in trees.items()], "root string, day date")
    listed = list_files(spark, [t.rstrip("/") for t in trees.values()])
    absent = [r["root"] for r in listed.filter("rel is null").collect()]
    if absent:
        raise SourceError(f"no such source tree: {', '.join(sorted(absent))}")
    return listed.join(roots, "root").select("day", "root", "rel", "length", "modified")


def tree_lines(spark: SparkSession, trees: dict[dt.date, str]) -> DataFrame:
    """(day, stream, symbol, block, seq, line) of the trees, headers included.

    ``block`` and ``seq`` give the order inside a file: where the split begins, and a number that grows within it.
    The day comes from the tree a file lies in, whatever the names and the number of trees; files deeper or higher in a
    tree than the two legal places yield no lines.
    """
    homes = [(f"{root}{below}", d) for d, t in trees.items() for root in [qualified(spark, t).rstrip("/")]
             for below in ("", f"/{d:%Y%m%d}")]
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(list(trees.values()))
    place = F.substring_index(F.col("_metadata.file_path"), "/", -2)
    home = F.col("_metadata.file_path").substr(F.lit(1), F.length(F.col("_metadata.file_path")) - F.length(place) - 1)
    lines = text.select(home.alias("home"), stream_of(F.col("_metadata.file_name")).alias("stream"),
                        F.substring_index(place, "/", 1).alias("symbol"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("seq"), without_return("value").alias("line"))
    # two rows a tree: a local relation whose size Catalyst knows
    return lines.join(small_frame(spark, homes, "home string, day date"), "home") \
        .select("day", "stream", "symbol", "block", "seq", "line")


def without_return(line: str) -> Column:
    """The line without one carriage return at its end."""
    c = F.col(line)
    return F.when(c.endswith("\r"), F.substring(c, 1, F.char_length(c) - 1)).otherwise(c)


def header_text(header: Column | str) -> Column:
    """Header bytes as text, null where they are no GBK. Only ever applied to tables with one row per file."""

    def text(value: bytes | None) -> str | None:
        try:
            return None if value is None else bytes(value).decode("gbk")
        except UnicodeDecodeError:
            return None

    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([text(v) for v in values], dtype=object)

    return F.pandas_udf(decode, "string")(header)

"""What a source tree must look like: rules over its paths, its files and its lines.

All rules yield rows (day, problem, detail). They work on tables of names, facts and lines wherever those come from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.schema import EMPTY_FILE_STREAMS, MAIN_PREFIXES, SOURCE_SYMBOL_PATTERN, STREAMS
from tapelake.sources.csv_tree import stream_of

BLANK = r"^[ \t\n\r\x0b\x0c]*$"


def placed_files(files: DataFrame) -> DataFrame:
    """Split ``rel`` into symbol and stream; ``problem`` says what is wrong with a path, null when nothing is.

    A path's parts and its place are each worked out once: filters on them stop at the explodes.
    """
    split = files.select("*", F.explode_outer(F.array(F.split("rel", "/"))).alias("parts"))
    parts = F.col("parts")
    nested = (F.size(parts) == 3) & (parts[0] == F.date_format("day", "yyyyMMdd"))
    flat = F.size(parts) == 2
    # indices are only looked at for the two legal depths
    symbol = F.when(nested, F.get(parts, 1)).when(flat, F.get(parts, 0))
    stream = stream_of(F.when(nested, F.get(parts, 2)).when(flat, F.get(parts, 1)))
    problem = F.when(~(nested | flat), "unregistered path") \
        .when(stream.isNull(), "unregistered file name") \
        .when(~symbol.rlike(SOURCE_SYMBOL_PATTERN), "malformed symbol folder")
    place = F.struct(symbol.alias("symbol"), stream.alias("stream"), problem.alias("problem"))
    placed = split.select(*files.columns, F.explode(F.array(place)).alias("place"))
    return placed.select(*files.columns, "place.symbol", "place.stream", "place.problem")


def in_universe(prefixes: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col("symbol").startswith(p) for p in prefixes], F.lit(False))


def dropped_by_prefix(placed: DataFrame, prefixes: tuple[str, ...] = MAIN_PREFIXES) -> DataFrame:
    """(day, prefix, symbols): how many symbols each day leaves out, by their first three characters."""
    return placed.filter("problem is null").filter(~in_universe(prefixes)) \
        .groupBy("day", F.substring("symbol", 1, 3).alias("prefix")).agg(F.count_distinct("symbol").alias("symbols"))


def symbol_streams(placed: DataFrame, prefixes: tuple[str, ...] = MAIN_PREFIXES) -> DataFrame:
    """(day, symbol, streams) over the kept symbols; ``streams`` is the sorted list of streams a symbol has."""
    kept = placed.filter("problem is null").filter(in_universe(prefixes))
    return kept.groupBy("day", "symbol").agg(F.sort_array(F.collect_set("stream")).alias("streams"))


def quote_only(by_symbol: DataFrame) -> DataFrame:
    """(day, symbol) with quotes alone: suspended, legal, recorded."""
    return by_symbol.filter(F.col("streams") == F.array(F.lit("xinqing"))).select("day", "symbol")


def _problems(rows: DataFrame, detail: Column, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return rows.select("day", F.explode(broken).alias("problem"), detail.alias("detail"))


def path_problems(placed: DataFrame, days: DataFrame, prefixes: tuple[str, ...] = MAIN_PREFIXES) -> DataFrame:
    """Bad paths, symbols lacking a stream, and streams no symbol of a day has."""
    bad = placed.filter("problem is not null").select("day", "problem", F.col("rel").alias("detail"))
    by_symbol = symbol_streams(placed, prefixes)
    partial = by_symbol.filter((F.size("streams") < len(STREAMS)) & (F.col("streams") != F.array(F.lit("xinqing"))))
    lacking = F.concat_ws(" ", F.col("symbol"), F.array_except(F.array(*[F.lit(s) for s in STREAMS]), "streams"))
    out = bad.unionByName(partial.select("day", F.lit("symbol lacks a stream").alias("problem"), lacking.alias("detail")))
    has = by_symbol.select("day", F.explode("streams").alias("stream")).distinct()
    every = days.select("day").distinct().select("day", F.explode(F.array(*[F.lit(s) for s in STREAMS])).alias("stream"))
    nothing = every.join(has, ["day", "stream"], "left_anti")
    return out.unionByName(nothing.select("day", F.lit("stream without any file").alias("problem"), F.col("stream").alias("detail")))


def line_facts(lines: DataFrame) -> DataFrame:
    """Per file what its lines show, header included. Counts only, so it combines before its one small shuffle.

    The line sits behind an explode, which Catalyst does not merge: copied into every aggregate, whatever makes the line
    outgrows what the JVM compiles.
    """
    keys = ["day", "stream", "symbol"]
    line = F.col("line")
    plain = F.is_valid_utf8(line) & (F.char_length(line) == F.octet_length(line))
    fields = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(","), F.lit(""))) + 1
    filled = F.octet_length(line) > 0
    return lines.select(*keys, F.explode_outer(F.array("line")).alias("line")).groupBy(*keys).agg(
        F.count_if(filled).alias("n_lines"),
        F.count_if(~plain).alias("n_not_ascii"),
        F.count_if(plain & line.contains('"')).alias("n_quoted"),
        F.count_if(plain & line.contains("\r")).alias("n_return"),
        F.min(F.when(filled & plain, fields)).alias("least_fields"),
        F.max(F.when(filled & plain, fields)).alias("most_fields"))


def file_facts(placed: DataFrame, facts: DataFrame, prefixes: tuple[str, ...] = MAIN_PREFIXES) -> DataFrame:
    """Kept files with their header and line facts; ``n_rows`` counts the non-empty lines below the header."""
    kept = placed.filter("problem is null").filter(in_universe(prefixes)).drop("problem")
    header = F.col("header").cast("string")
    header_ascii = F.is_valid_utf8(header) & (F.char_length(header) == F.octet_length(header))
    joined = kept.join(facts, ["day", "stream", "symbol"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_not_ascii", "n_quoted", "n_return")]
    rest = [c for c in joined.columns if c not in ("n_lines", "n_not_ascii", "n_quoted", "n_return")]
    # 0x2C never is a part of a two-byte GBK character, so commas may be counted on the raw bytes
    commas = F.octet_length(header) - F.octet_length(F.replace(header, F.lit(","), F.lit("")))
    return joined.select(*rest, *zero).withColumns({
        "header_fields": commas + 1, "header_ascii": header_ascii,
        "n_rows": F.greatest(F.col("n_lines") - 1, F.lit(0))})


def file_problems(facts: DataFrame) -> DataFrame:
    """Empty, headerless, non-ASCII, quoted and ragged files, headers that drift, streams that are empty throughout.

    Files of one day, stream and symbol have their lines in common, so what is wrong with a line is told once for all of them.
    """
    c = F.col
    filled = c("length") > 0
    headed = filled & ~c("header").cast("string").rlike(BLANK)
    header_lines = F.when(c("header_ascii"), 0).otherwise(1)
    quoted_header = F.when(c("header_ascii") & c("header").cast("string").contains('"'), 1).otherwise(0)
    detail = F.concat_ws(" ", "stream", "symbol")
    out = _problems(facts, detail, {
        "empty file in a stream not registered for it": ~filled & ~c("stream").isin(*EMPTY_FILE_STREAMS),
        "no header": filled & ~headed,
    })
    of_lines = _problems(facts, detail, {
        "body is not ASCII": headed & (c("n_not_ascii") > header_lines),
        "body holds a quote": headed & (c("n_quoted") > quoted_header),
        "line break inside a line": headed & (c("n_return") > 0),
        "no line was read": headed & (c("n_lines") == 0),
        "field count differs from the header": headed & (c("n_rows") > 0)
        & ((c("least_fields") < c("header_fields")) | (c("most_fields") > c("header_fields"))),
    })
    out = out.unionByName(of_lines.distinct())
    by_stream = facts.groupBy("day", "stream").agg(
        F.count_if(filled).alias("n_filled"), F.min(F.when(headed, F.hex("header"))).alias("low"),
        F.max(F.when(headed, F.hex("header"))).alias("high"))
    return out.unionByName(_problems(by_stream, F.col("stream"), {
        "headers differ inside a stream": c("low") != c("high"), "all files of a stream are empty": c("n_filled") == 0}))


def stream_receipts(facts: DataFrame) -> DataFrame:
    """(day, stream, n_symbols, n_rows_csv, header): empty files count neither as symbols nor as rows."""
    filled = F.col("length") > 0
    return facts.groupBy("day", "stream").agg(
        F.count_if(filled).alias("n_symbols"), F.sum("n_rows").alias("n_rows_csv"),
        F.min(F.when(filled, F.hex("header"))).alias("header_hex"))


def repeated_days(archives: DataFrame) -> DataFrame:
    """(day, names) for days that more than one canonical archive name stands for."""
    return archives.filter("day is not null").groupBy("day") \
        .agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("name").alias("last")).filter("n > 1")

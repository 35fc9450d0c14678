"""Physical text rows to typed rows: projection, decoding, filters, and the guard against unregistered short times."""

from __future__ import annotations

import datetime as dt
import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions import in_windows, is_short_time, to_int64, with_time_ms
from tapelake.schema import SYMBOL_COL, TIME_COL, Field, ReadRequest
from tapelake.session import small_frame

#: Ranges a symbol filter is pushed into the scan as.
_RANGES = 16


class UnregisteredShape(RuntimeError):
    """Data of a shape no registry entry covers."""


def needed_columns(request: ReadRequest) -> list[str]:
    """Physical columns the request reads, whether for output or for filtering."""
    columns = [SYMBOL_COL, *(f.column for f in request.output_fields)]
    if request.windows is not None:
        columns.append(TIME_COL)
    return list(dict.fromkeys(columns))


def symbol_ranges(symbols: frozenset[str]) -> list[tuple[str, str]]:
    """At most ``_RANGES`` closed ranges that hold the symbols, cut where neighbours are farthest apart."""
    names = sorted(symbols)

    def apart(i: int) -> int:
        low, high = (int.from_bytes(s.encode()[:9].ljust(9, b"\0")) for s in names[i - 1:i + 1])
        return high - low

    cuts = sorted(heapq.nlargest(_RANGES - 1, range(1, len(names)), key=apart))
    return [(names[first], names[end - 1]) for first, end in zip([0, *cuts], [*cuts, len(names)])] if names else []


def keep_symbols(df: DataFrame, symbols: frozenset[str] | None) -> DataFrame:
    """Exact symbol filter of a list of any length: a few ranges are pushed into the parquet scan, a semi join does the rest.

    Ranges of one symbol each are exact by themselves.
    """
    if symbols is None:
        return df
    quoted = [tuple("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in ends) for ends in symbol_ranges(symbols)]
    tests = [f"{SYMBOL_COL} = {low}" if low == high else f"{SYMBOL_COL} BETWEEN {low} AND {high}" for low, high in quoted]
    near = df.filter(" OR ".join(tests) or "false")
    if all(low == high for low, high in quoted):
        return near
    wanted = small_frame(df.sparkSession, [(s,) for s in sorted(symbols)], f"{SYMBOL_COL} string")
    return near.join(wanted, SYMBOL_COL, "left_semi")


def decoded(f: Field) -> Column:
    """A field's value from its physical column; times are decoded by the scan itself."""
    return to_int64(f.column) if f.kind in ("int", "price") else F.col(f.column)


def typed_rows(raw: DataFrame, request: ReadRequest, patched_days: list[dt.date], keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed, filtered rows with ``day`` and ``symbol`` first; ``keep`` names extra columns to carry at the end.

    ``raw`` has ``day`` and the physical columns. Short times are read on ``patched_days`` only.
    """
    rows = keep_symbols(raw, request.symbols)
    times = [f for f in request.output_fields if f.kind == "time"]
    if times or request.windows is not None:
        allowed = F.col("day").isin(patched_days) if patched_days else F.lit(False)
        rows = with_time_ms(rows, TIME_COL, "time_ms", allowed)
    if request.windows is not None:
        rows = rows.filter(in_windows("time_ms", request.windows))
    fields = [(F.col("time_ms") if f.kind == "time" else decoded(f)).alias(f.name) for f in request.output_fields]
    return rows.select("day", F.col(SYMBOL_COL).alias("symbol"), *fields, *keep)


def short_times(raw: DataFrame, patched: Column | None = None) -> DataFrame:
    """(day, n) for days with five- or six-digit times, days under ``patched`` left out. Reads the time column only."""
    short = is_short_time(TIME_COL)
    rows = raw.filter(short if patched is None else short & ~patched)
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def check_short_times(counts: DataFrame, request: ReadRequest) -> None:
    """Raise when ``counts`` (day, n) has a day with short times, of whatever symbol; registered days are not in it."""
    found = counts.filter("n > 0").sort("day").collect()
    if found:
        days = ", ".join(f"{r['day']:%Y-%m-%d} ({r['n']} rows)" for r in found)
        raise UnregisteredShape(f"time_6digit is not registered for {request.stream} on {days}")

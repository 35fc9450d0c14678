"""Clock text to milliseconds since midnight, and filters on it.

HHMMSSmmm may lose its leading zero before ten o'clock (nine or eight characters). HHMMSS and HMMSS (six or five) are
read only where the caller allows it. Everything else, impossible clock values included, becomes null.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelake.functions.numbers import as_column, framed_by_digits
from tapelake.schema import Window

_PADDED_LONG = r"(?U)^\s*([0-9]{8,9})\s*$"
_PADDED_SHORT = r"(?U)^\s*([0-9]{5,6})\s*$"


def _clock(c: Column, allow_short: Column) -> Column:
    """The digits as one integer HHMMSSmmm, null for any other text. Padded text takes the regular expressions."""
    width = F.octet_length(c)
    digits = c.try_cast("int")
    plain = F.when(width.isin(8, 9), digits).when(width.isin(5, 6) & allow_short, digits * 1000)
    padded = F.coalesce(F.regexp_extract(c, _PADDED_LONG, 1).try_cast("int"),
                        F.when(allow_short, F.regexp_extract(c, _PADDED_SHORT, 1).try_cast("int") * 1000))
    return F.when(framed_by_digits(c), plain).when(width > 5, padded)


def _clock_to_ms(clock: Column) -> Column:
    valid = (clock < 240_000_000) & (clock % 10_000_000 < 6_000_000) & (clock % 100_000 < 60_000)
    hours = F.call_function("div", clock, F.lit(10_000_000))
    minutes = F.call_function("div", clock % 10_000_000, F.lit(100_000))
    return F.when(valid, hours * 3_600_000 + minutes * 60_000 + clock % 100_000)


def to_time_ms(c: Column | str, allow_short: Column | bool = False) -> Column:
    """Clock text to bigint milliseconds; ``allow_short`` (a column or a constant) admits five and six digits.

    For scans use :func:`with_time_ms`, which keeps the intermediate integer in a column of its own.
    """
    allowed = allow_short if isinstance(allow_short, Column) else F.lit(allow_short)
    return _clock_to_ms(_clock(as_column(c), allowed))


def with_time_ms(df: DataFrame, c: str, name: str, allow_short: Column | bool = False) -> DataFrame:
    """Add the decoded time as a column that later filters read but never recompute.

    Catalyst pushes a filter below the projection it reads from by copying the projected expression into it, once per
    mention; the copies outgrow what the JVM compiles and the scan becomes a hundred times slower. An outer explode of
    a one-element array keeps the row count and stops exactly those filters; filters on other columns still reach the
    scan.
    """
    allowed = allow_short if isinstance(allow_short, Column) else F.lit(allow_short)
    clock, slot = f"{name}__clock", f"{name}__slot"
    decoded = df.withColumn(clock, _clock(F.col(c), allowed)).withColumn(slot, F.array(_clock_to_ms(F.col(clock))))
    return decoded.select(*df.columns, F.explode_outer(slot).alias(name))


def is_short_time(c: Column | str) -> Column:
    """True for exactly five or six digits between optional white space; false, never null, otherwise."""
    c = as_column(c)
    width = F.octet_length(c)
    candidate = (width >= 5) & ((width <= 6) | ~framed_by_digits(c))
    return F.coalesce(candidate & c.rlike(_PADDED_SHORT), F.lit(False))


def in_windows(time_ms: Column | str, windows: Iterable[Window]) -> Column:
    """True when the time lies in any half-open window; no window at all is false for every row."""
    t = as_column(time_ms)
    inside = [(t >= w.start_ms) & (t < w.end_ms) for w in windows]
    return reduce(lambda a, b: a | b, inside, F.lit(False))

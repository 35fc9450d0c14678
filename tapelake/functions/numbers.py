"""Untyped text to 64-bit integers, as plain column expressions.

A value is read through double precision. Text that is not a decimal number, numbers outside the 64-bit range and
integers a double cannot hold exactly all become null; fractions are cut towards zero.

Nearly every value in real data is a short run of digits. Such a value is told apart by its first and last character
and its length, and costs one integer cast. Only the rest pays for regular expressions. A failing cast costs an
exception per row, a hundred times the price of a regular expression, so text is cast only when the cast will succeed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_EXACT = r"^[+-]?0*[0-9]{1,19}$"
# The characters Unicode calls white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_EXACT_DIGITS = 15            # integers of up to 15 characters are always exact in a double


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def framed_by_digits(c: Column) -> Column:
    """True when the first and the last character are ASCII digits."""
    last = F.substring(c, -1, 1)
    return (c >= "0") & (c < ":") & (last >= "0") & (last < ":")


def strip_edges(c: Column | str) -> Column:
    """Drop white space (Unicode included) at both ends; other characters, NUL included, stay."""
    return F.btrim(as_column(c), F.lit(_WHITE))


def to_int64(c: Column | str) -> Column:
    """Text to bigint; null when the text is no number, out of range, or an integer a double cannot hold."""
    c = as_column(c)
    # A bare cast would also accept control characters at the ends, so both ends are looked at first.
    short_integer = (F.octet_length(c) <= _EXACT_DIGITS) & framed_by_digits(c) & ~c.contains(".") & ~c.contains("e")
    text = strip_edges(c)
    other_number = (F.octet_length(c) > 0) & text.rlike(_NUMBER)
    return F.coalesce(F.when(short_integer, c.try_cast("bigint")), F.when(other_number, _through_double(text)))


def _through_double(number: Column) -> Column:
    d = number.try_cast("double")
    whole = F.when((d >= F.lit(-(2.0**63))) & (d < F.lit(2.0**63)), d.cast("bigint"))
    exact = F.when(number.rlike(_EXACT), number.try_cast("bigint"))
    return F.when(F.coalesce(exact == whole, F.lit(True)), whole)

"""Days and paths from names, as columns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapelake.functions.numbers import as_column

# A day of a stream is one file or one folder: date=YYYYMMDD.parquet, or date=YYYYMMDD with part files.
STORE_FILE = r"/date=([0-9]{8})(?:\.parquet)?(?:/part-[^/]*\.parquet)?$"
MANIFEST_FILE = r"/manifest/(?:v=[^/]+/)?(?:date=)?([0-9]{8})(?:\.json)?(?:/part-[^/]*\.json)?$"


def _calendar_day(digits: Column) -> Column:
    """Eight digits to a date; null for anything else, impossible dates included."""
    return F.try_to_date(F.when(digits.rlike("^[0-9]{8}$"), digits), "yyyyMMdd")


def archive_day(name: Column | str) -> Column:
    """``YYYYMMDD.7z`` to its date; any other name is null."""
    return _calendar_day(F.regexp_extract(as_column(name), r"^([0-9]{8})\.7z$", 1))


def file_day(path: Column | str) -> Column:
    """The day of a file inside the store, null when the path has another shape."""
    return _calendar_day(F.regexp_extract(as_column(path), STORE_FILE, 1))


def day_folder(top: str, run: str, day: dt.date) -> str:
    """Where a run puts a day of a stream, or its manifest."""
    return f"{top}/v={run}/date={day:%Y%m%d}"
